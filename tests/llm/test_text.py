import os

import numpy as np
import pytest

from skein.llm import packing, spampages, tokens

HF = "/opt/tokenizers/byte_bpe_50k.json"
pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT), reason="no vocabulary")

TEXTS = [
    "Hello world, it's  fine.\n\n  Indented\ttabs ", "", None, " ", "   ", "日本語のテキスト。東京は大きい", "مرحبا بالعالم", "Привет, мир! 123 4567", "a" * 5000, "ab" * 3000, "\x00\x7f​﻿", "👍🏽👨‍👩‍👧 café ﬁ",
    "<|endoftext|> special", "don't we'll I'VE", "x\r\ny z\xa0w", "퟿", " ".join(f"w{i}" for i in range(3000)), "Ã¤Â¶", "é" * 50,
]


@pytest.fixture(scope="module")
def hf():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(HF)
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def docs(spark, texts=TEXTS):
    # names that also occur inside the operators
    return spark.createDataFrame([(i, t, "x", 1, None) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, n_tokens int, key bigint").repartition(3)


def test_ids_equal_the_library(spark, hf):
    got = {r["doc_id"]: r["ids"] for r in tokens.encode_corpus(docs(spark)).collect()}
    assert got == {i: hf(t) for i, t in enumerate(TEXTS)}
    assert got[1] == [] and got[2] == []


def test_round_trip(spark):
    back = {r["doc_id"]: r["text"] for r in tokens.decode_corpus(tokens.encode_corpus(docs(spark))).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_random_words_in_random_chunks():
    v = tokens.Vocabulary()
    rng = np.random.default_rng(0)
    for alphabet in ("ab", "the nation ing", "abcdefghijklmnopqrstuvwxyz", "-=_", "éüß日"):
        for n in (1, 7, 300):
            data = "".join(rng.choice(list(alphabet), n)).encode()
            cut = sorted(rng.integers(0, len(data) + 1, 4).tolist())
            chunks = [data[a:b] for a, b in zip([0, *cut], [*cut, len(data)], strict=True)]
            assert list(v.stream(chunks)) == v.merged(data)


def test_tokens_leave_before_the_end_and_memory_stays_constant():
    v = tokens.Vocabulary()
    read = 0

    def chunks():
        nonlocal read
        for _ in range(400):
            read += 100
            yield b"abcdefghij" * 10

    early = 0
    for _ in v.stream(chunks()):
        early += read < 40_000
    assert early > 0
    assert v.window == max(map(len, v.ranks))


def test_broken_bytes_decode_to_replacement():
    v = tokens.Vocabulary()
    assert "".join(v.decode([v.ranks[b"\xe6"], v.ranks[b"a"]])) == "�a"


def test_hilbert_is_a_walk():
    p = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    k = packing.hilbert(p, 3)
    assert sorted(k) == list(range(512))
    assert (np.abs(np.diff(p[np.argsort(k)], axis=0)).sum(1) == 1).all()


def test_packing_is_whole_and_tight(spark, hf, monkeypatch):
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["red", "green", "kettle", "lamp", "quite", "good"], rng.integers(1, 60))) for _ in range(800)] + ["word " * 700, "word " * 300, "same text"] + ["same text"] * 50 + [None, "", " "]
    monkeypatch.setattr(packing, "PER_PARTITION", 60)
    rows = packing.pack(packing.sized(docs(spark, texts)), capacity=256).collect()
    size = {i: len(hf(t)) for i, t in enumerate(texts)}
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["n_tokens"]))
    assert set(got) == {i for i, n in size.items() if n}
    for i, pieces in got.items():
        pieces.sort()
        assert [p for p, _, _ in pieces] == list(range(len(pieces))) and sum(n for _, _, n in pieces) == size[i]
        assert [s for _, s, _ in pieces] == [256 * k for k in range(len(pieces))]
        assert len(pieces) == -(-size[i] // 256)  # in one piece unless over the capacity
    used = {}
    for r in rows:
        used[r["container_id"]] = used.get(r["container_id"], 0) + r["n_tokens"]
    assert max(used.values()) <= 256 and sum(used.values()) / (256 * len(used)) > 0.95


def test_neighbours_share_containers(spark):
    texts = [("kettle boils water " if i % 2 else "desk lamp shines bright ") * 9 for i in range(400)]
    k = packing.curve_keys([tokens.vocabulary().encode(t) for t in texts])
    assert len(set(k[::2])) == 1 and len(set(k[1::2])) == 1 and k[0] != k[1]


def test_long_texts_and_words_in_chunks(monkeypatch):
    v = tokens.vocabulary()
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("abcdeé日👍"), 3000)), " ".join(GOOD.values()) * 5, "x" * 7000, "日本語" * 900]
    want = [v.encode(t) for t in texts]
    monkeypatch.setattr(tokens, "WHOLE", 50)
    monkeypatch.setattr(tokens, "CHUNK", 7)
    v.words.clear()
    assert [v.encode(t) for t in texts] == want and ["".join(v.decode(w)) for w in want] == texts


def test_packed_documents_are_neighbours_on_the_curve(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(n), int(k)) for i, (n, k) in enumerate(zip(np.exp(rng.normal(4.5, 1, 6000)).astype(int) + 1, rng.integers(0, 1 << 48, 6000), strict=True))]
    items = spark.createDataFrame(rows, "doc_id bigint, n_tokens bigint, key bigint")
    place = {i: p for p, (i, _, _) in enumerate(sorted(rows, key=lambda r: (r[2], r[0])))}
    packed = packing.pack(items).collect()
    held = {}
    for r in packed:
        held.setdefault(r["container_id"], []).append(place[r["doc_id"]])
    span = np.array([max(p) - min(p) for p in held.values()])
    assert np.median(span) <= packing.WINDOW and np.percentile(span, 90) <= 4 * packing.WINDOW  # of 6,000
    used = sum(r["n_tokens"] for r in packed) / (packing.CAPACITY * len(held))
    assert used > 0.995


def test_empty_tables(spark):
    none = docs(spark).limit(0)
    assert tokens.encode_corpus(none).collect() == []
    assert packing.pack(packing.sized(none)).collect() == []
    assert spampages.spam_pages(none).collect() == []
    assert packing.fill(packing.pack(packing.sized(none))).first()["containers"] == 0


GOOD = {
    "en": "Bought this kettle in Harbour Lane and it has been reliable ever since. My flatmate noticed how quiet the lid is. Setting it up took twelve minutes, no tools needed. The courier left the parcel with a neighbour, which was kind. ",
    "de": "Gekauft in Lindau, und meine Schwester findet das Stück robust. Aufbau in zehn Minuten, ganz ohne Werkzeug. Der Deckel ist leise und wirkt wie neu. Zum Bezug kann ich sonst wenig sagen, aber der Griff liegt gut in der Hand. ",
    "ru": "Здесь ручка тихая, и после двух дней всё как новое. Коробка пришла из Казани. Сборка заняла пять минут, и сестра довольна. Мой сосед говорит, что молния слишком тугая, но мне она нравится больше прежней. ",
    "ja": "組み立ては二十分で終わりました。二日でふたが壊れました。配達の人は間違えて古い棚を運びました。同僚も便利だと言っていました。色は思ったより明るくて気に入っています。",
    "ar": "قال جاري إن المقبض مريح بعد شهر. جاء الطرد من دمشق. زوجتي فتحت الصندوق هذا الصباح. لم أجد أي عيب في الغطاء حتى الآن، وأنصح به كل صديق. ",
}
BAD = {
    "keywords": "cheap kettle buy kettle kettle offer kettle best kettle " * 8,
    "commas": "cheap kettle, kettle offer, best kettle, buy kettle, kettle, " * 8,
    "stops": "yoga mat with yoga mat for yoga mat! yoga mat in yoga mat and yoga mat. yoga mat by yoga mat or yoga mat. " * 4,
    "links": "\n".join(f"https://shop{i}.example/p/{i * 7919}" for i in range(14)),
    "anchors": " ".join(f"<a href='http://shop{i}.test/x'>deal {i}</a>" for i in range(12)),
    "tags": "tags: " + " ".join(f"#{w}{i}" for i in range(12) for w in ("lamp", "kettle", "sale")),
    "rows": " ; ".join(f"Maker{chr(65 + i)} kettle D{i * 37} {i * 13 % 97}.{i:02d}" for i in range(16)),
    "cyrillic": "чайник купить чайник дёшево чайник скидка чайник " * 7,
    "cjk": "やかん セール やかん 激安 やかん 人気 やかん 送料無料 " * 8,
    "mixed": GOOD["en"][:80] + ". " + "cheap kettle, kettle offer, best kettle, buy kettle, kettle, " * 6,
}
SMALL = ["Great kettle", "+1", "", " ", None, "👍👍", "<p></p>", "!!!!", "http://a.example/x"]


@pytest.mark.parametrize("name", list(BAD))
def test_spam(name):
    assert spampages.Judge().measure(BAD[name])[0] > 0.5


@pytest.mark.parametrize("lang", list(GOOD))
def test_sentences_are_no_spam(lang):
    for text in (GOOD[lang], GOOD[lang] + " https://a.example/x see there.", "<p>" + GOOD[lang].replace(". ", ".<br/>") + "</p>", GOOD[lang].lower(), GOOD[lang].replace(".", " ."), GOOD[lang] + "#tag #other"):
        assert spampages.Judge().measure(text)[0] <= 0.5


def test_mojibake_is_read_again():
    text = GOOD["ru"].encode().decode("latin-1")
    assert spampages.Judge().measure(text)[0] <= 0.5


def test_remarks_and_blanks_are_no_spam():
    assert all(spampages.Judge().measure(t)[0] == 0 for t in SMALL)


def test_pages_over_a_table(spark):
    texts = [*BAD.values(), *GOOD.values(), *SMALL, " ".join(GOOD.values()), BAD["keywords"] * 400]
    got = {r["doc_id"] for r in spampages.spam_pages(docs(spark, texts)).collect()}
    assert got == {*range(len(BAD)), len(texts) - 1}
    m = spampages.measures(docs(spark, texts)).collect()
    assert len(m) == len(texts) and all(0 <= r["flagged_share"] <= 1 for r in m)

VERSE = """The lamp is low, the kettle sings,
a slow rain taps the garden wall
while somewhere past the railway things
we never mended start to call
and nobody remembers now
who left the ladder in the hall"""
PLAIN = "we moved here late in the autumn and the old boiler gave up within a week so my neighbour lent us two heaters and a pile of blankets which kept the children warm while I phoned around for someone who could look at the pipes before the frost came back and made everything worse than it already was"


def test_verse_and_prose_without_stops_are_no_spam(spark):
    texts = [VERSE, PLAIN, PLAIN.upper(), *BAD.values()]
    for t in texts[:2]:
        assert spampages.Judge().measure(t)[0] <= 0.5
    if os.path.isdir("/root/testdata/sf0.01"):  # judged by the baselines of a corpus
        corpus = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
        more = spark.createDataFrame([(-1 - i, t, "en") for i, t in enumerate(texts)], "doc_id bigint, text string, lang string")
        m = {r["doc_id"]: r for r in spampages.measures(corpus.unionAll(more)).where("doc_id < 0").collect()}
        assert all(m[-1 - i]["outside_share"] > 0.5 and m[-1 - i]["flagged_share"] == 0 for i in range(3))
        assert all(m[-4 - i]["flagged_share"] > 0.5 for i in range(len(BAD)))


def test_sentences_repeated_are_no_spam_and_stops_do_not_hide_keywords():
    said = "My sister carried the lamp upstairs. "
    assert spampages.Judge().measure(said * 2 + GOOD["en"] * 2)[0] <= 0.5
    assert spampages.Judge().measure("Lampe kaufen Lampe. Lampe und Lampe mit Lampe. Lampe billig und Lampe. " * 6)[0] > 0.5


def test_baselines_by_language_and_writing_system(spark):
    texts = [(i, g, lang) for i, (lang, g) in enumerate(list(GOOD.items()) * 40)] + [(1000, GOOD["ru"], "en"), (1001, GOOD["en"], None)]
    base = spampages.baselines(spampages.materialize(spampages.read(spark.createDataFrame(texts, "doc_id bigint, text string, lang string")), "b"))
    kinds = {(s, g) for s, g, _ in base}
    assert {("latin", "en"), ("latin", "de"), ("cyrillic", "ru"), ("latin", ""), ("cjk", "ja")} <= kinds and ("cyrillic", "en") not in kinds
