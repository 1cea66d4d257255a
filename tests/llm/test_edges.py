"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import pytest

from quadrille.llm import decontaminate, embedding_dedup, jaccard, language_id, language_model, mixing, sharding, token_counts, token_files, warc
from quadrille.llm.common import new_path

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, h string, sid string, block string"
WORDS = " ".join(f"word{i}" for i in range(40))
ROWS = [
    (1, WORDS, "en", "a", 5, "x", "x", "x"),
    (2, WORDS, "en", "a", 5, "x", "x", "x"),
    (2, WORDS, "en", "a", 5, "x", "x", "x"),
    (3, None, None, None, None, None, None, None),
    (4, "", "en", None, 0, "x", "x", "x"),
    (5, " \t\n", "en", "b", 3, "x", "x", "x"),
    (6, "你好 123 ...", "zh", "b", 3, "x", "x", "x"),
    (None, "no id here at all, really", "en", "a", 3, "x", "x", "x"),
    (7, WORDS.upper() + " more", "en", "c", 9, "x", "x", "x"),
    (8, "long " * 60_000, "en", "c", 9, "x", "x", "x"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_jaccard(docs, none):
    found = sorted(map(tuple, jaccard.classes(docs).collect()), key=repr)
    classes = {(r[0], r[2]) for r in found}
    assert len(found) == len(ROWS) and {(1, 1), (2, 1), (7, 1), (3, 3), (4, 4), (8, 8), (None, None)} <= classes
    assert jaccard.classes(none).count() == 0
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 8]


def test_jaccard_of_many_near_copies_matches_brute_force(spark, monkeypatch):
    import random

    monkeypatch.setattr(jaccard, "PAGE", 8)
    draw = random.Random(7)
    base = [f"w{i}" for i in range(120)]
    texts = [base[: 30 + i % 90] for i in range(90)] + [[x if draw.random() > 0.03 else f"x{draw.random()}" for x in base] for _ in range(150)]
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    own = [{tuple(x[j : j + 5]) for j in range(len(x) - 4)} for x in texts]
    root = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(own[a] & own[b])
            if 100 * both >= 75 * (len(own[a]) + len(own[b]) - both):
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    found = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found == dict(enumerate(root)) and len(set(root)) > 20


def test_language(docs, none):
    assert language_id.keep_identified(docs).columns == docs.columns
    model = language_id.train(docs)
    found = {r["doc_id"]: r["language"] for r in language_id.identify(docs, model).collect()}
    assert found[3]["lang"] == found[4]["lang"] == found[5]["lang"] == "und"
    assert found[8]["lang"] == "en" and found[6]["lang"] == "zh"
    assert language_id.identify(none, language_id.train(none)).count() == 0
    assert {r["language"]["lang"] for r in language_id.identify(docs, language_id.train(none)).collect()} == {"und"}


def test_language_stage_rejects_only_texts_without_letters(spark):
    import numpy as np

    words = {"aa": "ballo bano batta bolu", "cc": "drife drosk drenk drusp", "ee": "ximiz xeqiz xuviz xoqez"}
    rows = [(i, " ".join(words[lang].split() * 10), lang) for i, lang in enumerate(list(words) * 10)]
    mixed = " ".join(words["aa"].split() * 10 + words["cc"].split() * 7 + words["ee"].split() * 7)
    rows += [(100, mixed, None), (101, "123 ...", None), (102, None, None), (103, "", "aa")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    found = language_id.identify(docs, language_id.train(docs)).filter("doc_id = 100").first()["language"]
    assert found["score"] < 0.5 and [x["lang"] for x in found["spans"]] == ["aa", "cc", "ee"]
    assert sorted(r["doc_id"] for r in language_id.keep_identified(docs).collect()) == [*range(30), 100]
    blind = language_id.keep_identified(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert sorted(r["doc_id"] for r in blind.collect()) == [*range(30), 100]
    scores = np.full((6, 300), -6, np.float32)
    scores[:3, 290] = scores[3:, 299] = 0
    assert language_id.viterbi(scores, np.array([0, 3, 6])).tolist() == [290] * 3 + [299] * 3


def test_language_model(docs, none):
    found = language_model.score(docs.select("doc_id", "text")).collect()
    assert len(found) == len(ROWS) and all(r["score"] < 0 and r["n_tokens"] >= 1 for r in found)
    assert language_model.score(none.select("doc_id", "text")).count() == 0


def test_embeddings(spark):
    schema = "vec_id bigint, embedding array<float>, label int, v string, cell string"
    rows = [(1, [1.0, 0.0], 1, "x", "x"), (2, [2.0, 0.0], 1, "x", "x"), (3, [1.0, 0.0], 2, "x", "x"), (4, None, 1, "x", "x"), (5, [0.0, 0.0], 1, "x", "x"), (6, [float("nan"), 1.0], 1, "x", "x"), (7, [None, 1.0], 1, "x", "x"), (8, [1.0, 0.0], None, "x", "x"), (None, [1.0, 0.0], 1, "x", "x"), (9, [], 1, "x", "x")]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.links(spark.createDataFrame(rows, schema)).collect()}
    assert found[1] == (1, 1, True) and found[2] == (1, 1, False) and len(found) == len(rows)
    assert all(found[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9)) and found[None] == (0, None, False)
    assert embedding_dedup.links(spark.createDataFrame([], schema)).count() == 0


def test_embeddings_of_several_lengths_match_brute_force(spark):
    import numpy as np

    draw = np.random.default_rng(5)
    rows = []
    for width, n in ((64, 180), (128, 120), (1, 6), (3, 20)):
        hubs = draw.normal(size=(max(1, n // 6), width))
        for i in range(n):
            v = hubs[i % len(hubs)] + (0 if i % 5 == 0 else draw.uniform(0, 0.25)) * draw.normal(size=width)
            rows.append((len(rows), [float(x) for x in v * draw.uniform(0.5, 2)], i % 2))
    # The start of a longer vector, and the same filled up with zeros, have no common length with it.
    rows += [(len(rows), rows[200][1][:64], 0), (len(rows) + 1, rows[0][1] + [0.0] * 64, 0)]
    n_links, root = [0] * len(rows), list(range(len(rows)))
    for a, v, label in rows:
        for b, w, other in rows:
            if a != b and label == other and len(v) == len(w) and np.dot(v, w) / np.sqrt(np.dot(v, v) * np.dot(w, w)) >= 0.98:
                n_links[a] += 1
                x, y = sorted((root[a], root[b]))
                root = [x if r == y else r for r in root]
    found = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()}
    assert found == {i: (n_links[i], root[i], root[i] == i) for i in range(len(rows))}
    assert all(any(n_links[i] for i, v, _ in rows if len(v) == width) for width in (1, 3, 64, 128))


def test_sharding(docs, none):
    rows = sharding.shuffle(docs, 4).collect()
    assert len(rows) == len(ROWS) and sharding.shuffle(none, 4).count() == 0
    assert sorted(map(repr, rows)) == sorted(map(repr, sharding.shuffle(docs, 4).collect()))


def test_token_files(spark, docs, none):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    found = token_files.read_back(spark, token_files.write(docs, new_path(spark, "tokens"), path)).collect()
    assert len(found) == len(ROWS) and {r["n_tokens"] for r in found if r["doc_id"] in (3, 4)} == {1}
    assert token_files.read_back(spark, token_files.write(none, new_path(spark, "tokens"), path)).count() == 0


def test_texts_with_added_tokens_encode_as_plain(spark, tmp_path):
    import zlib
    from collections import Counter

    import numpy as np
    import public_tokenizers
    from tokenizers import AddedToken, Tokenizer

    end, path = "<|endoftext|>", public_tokenizers.path("byte_bpe_50k.json")
    texts = [f"a {end} b", end, f"{end}{end} c", f"no{end}blank", f"é {end}\n 你好", "<|endof text|>", "a b", "", f" {end} ", f"{WORDS} {end} {WORDS}"]
    own = Tokenizer.from_file(path)
    ids = [own.encode(x, add_special_tokens=False).ids for x in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = sorted(map(tuple, token_files.read_back(spark, token_files.write(docs, new_path(spark, "tokens"), path)).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    starts = np.cumsum([0, *[len(x) + 1 for x in ids]])
    assert found == [(i, starts[i], len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, x in enumerate(ids)]
    assert {r["n_tokens"]: r["docs"] for r in token_counts.lengths(docs, path).collect()} == Counter(map(len, ids))
    # Tokens that aren't special, and one that pieces of other texts make where they meet.
    own.add_tokens([AddedToken("wx yz", normalized=False), AddedToken("q", single_word=True, normalized=False)])
    own.save(str(tmp_path / "more.json"))
    more = token_files.Encoder(str(tmp_path / "more.json"))
    for text in ("m wx", "q yz", "a wx yz", "aq q", "n wx", "yz", f"b wx k yz wx {end}", "o wx p yz"):
        assert more.encode(text).tolist() == own.encode(text, add_special_tokens=False).ids
    more.known.clear()
    more._learn(["wx", "yz"])  # pieces are known by what follows their blank
    assert [np.frombuffer(more.known[x], "<u4").tolist() for x in ("wx", "yz")] == [own.encode(f" {x}", add_special_tokens=False).ids for x in ("wx", "yz")]


def test_random_texts_encode_as_plain():
    import random

    import public_tokenizers

    draw, path = random.Random(3), public_tokenizers.path("byte_bpe_50k.json")
    parts = ["a", "b", "Zé", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "n't", ",", "1", "23", "_", "\r\n", "\x1c", "\xa0", "你好", "é", "<|endoftext|>", "###", "!", " x", " Y."]
    texts = ["".join(draw.choice(parts) for _ in range(draw.randint(0, 14))) for _ in range(20_000)]
    own = token_files.Encoder(path)
    expected = [x.ids for x in own.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_all(texts)] == expected
    assert [x.tolist() for text in texts[:500] for x in own.encode_all([text])] == expected[:500]


def test_token_files_deal_equal_ids_by_text(spark):
    docs = spark.createDataFrame([(7 if i % 2 else None, f"text {i}") for i in range(300)], "doc_id bigint, text string")
    import public_tokenizers

    files = token_files.write(docs, new_path(spark, "tokens"), public_tokenizers.path("byte_bpe_50k.json"), 4)
    assert files.count() == 4
    found = token_files.read_back(spark, files).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None] * 150 + [7] * 150
    assert [r["start"] for r in found[1:]] == [r["start"] + r["n_tokens"] for r in found[:-1]]


CLASHES = ("salt", "leak", "leak_0", "language_", "mix_source", "mix_lam", "mix_copies", "mix_copy", "mark", "position", "before", "Before", "gone", "twice", "place", "sid", "comp")


def test_clashing_names_are_kept(spark):
    names = [n for n in CLASHES if n != "Before"]
    rows = [(i, WORDS if i < 3 else f"Some words of number {i} here", "en", f"s{i % 2}", *[f"{n}{i}" for n in names]) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    items = spark.createDataFrame([("a", " ".join(WORDS.split()[:15]))], "item_id string, text string")
    own = {r[0]: tuple(r) for r in rows}
    for kept in (language_id.keep_identified(docs), jaccard.keep_one(docs), decontaminate.remove(docs, items), mixing.mix(docs), sharding.shuffle(docs, 3).select(*docs.columns)):
        assert kept.columns == docs.columns
        found = kept.collect()
        assert found and all(tuple(r) == own[r["doc_id"]] for r in found)


def test_shards_grow_as_sharding_anew_into_one_more(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id bigint, text string")
    now = {r["doc_id"]: r["shard"] for r in sharding.shuffle(docs, 40).collect()}
    new = {r["doc_id"]: r["shard"] for r in sharding.shuffle(docs, 41).collect()}
    assert all(new[i] in (now[i], 40) for i in now) and 0 < sum(x == 40 for x in new.values()) < 40


def test_decontamination_over_several_blocks_of_items(spark, docs, monkeypatch):
    items = spark.createDataFrame([(f"i{k}", " ".join(WORDS.split()[k : k + 12])) for k in range(20)] + [("none", "nowhere to be found at all in these few documents here")], "item_id string, text string")
    whole = {tuple(r["leak"][k] if k != "spans" else tuple(map(tuple, r["leak"]["spans"])) for k in ("n_words", "n_hit", "spans")) + (tuple(r["leak"]["items"]), r["doc_id"]) for r in decontaminate.find(docs, items).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 400)
    cut = {tuple(r["leak"][k] if k != "spans" else tuple(map(tuple, r["leak"]["spans"])) for k in ("n_words", "n_hit", "spans")) + (tuple(r["leak"]["items"]), r["doc_id"]) for r in decontaminate.find(docs, items).collect()}
    assert cut == whole and any(len(x[3]) == 20 for x in cut)


def test_warc(spark):
    schema = "page_id bigint, url string, html string, record string"
    big = "<p>" + "x" * 3_000_000
    rows = [(1, "u", big, "r"), (2, None, big, "r"), (3, "u\r\nv", None, "r"), (4, "u", "", "r"), (None, "u", big, "r"), (5, "u", "short", "r"), (6, "u", "short", "r")]
    pages = spark.createDataFrame(rows, schema)
    archives = warc.write(warc.chunked(warc.records(pages)), new_path(spark, "warc"))
    read = warc.scan(spark, archives).collect()
    body = {}
    for r in sorted(read, key=lambda r: (r["record"], r["chunk_no"])):
        body[r["record"]] = body.get(r["record"], b"") + bytes(r["data"])
    kinds = {r["record"]: (r["kind"], r["refers_to"]) for r in read}
    assert body["2"] == big.encode() and kinds["1"] == ("revisit", "2") and kinds["5"] == kinds["6"] == ("response", None)
    assert len(kinds) == len(rows) and warc.write(warc.chunked(warc.records(pages.limit(0))), new_path(spark, "warc")).count() == 0


def test_mixing(docs, none):
    assert mixing.mix(docs).columns == docs.columns
    assert mixing.mix(none).count() == 0


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([("a", " ".join(WORDS.split()[5:20])), ("b", "short one"), ("c", None), (None, WORDS), ("d", "")], "item_id string, text string")
    found = {r["doc_id"]: r["leak"] for r in decontaminate.find(docs, items).collect()}
    assert found[1]["n_hit"] == 15 and found[1]["items"] == ["a"] and found[3]["n_words"] == 0
    assert sorted(r["doc_id"] or 0 for r in decontaminate.remove(docs, items).collect()) == [0, 3, 4, 5, 6, 8]
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove(docs, items, mode="spans").collect()}
    assert "word5 " not in cut[1] and "word30" in cut[1] and cut[3] is None
    assert decontaminate.find(none, items).count() == 0
    assert {r["leak"]["n_hit"] for r in decontaminate.find(docs, items.limit(0)).collect()} == {0}


def test_token_counts(docs, none, spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    sizes = sorted(len(own.encode(r[1] or "", add_special_tokens=False).ids) for r in ROWS)
    sums = token_counts.token_counts(docs, path)
    assert sum(r["docs"] for r in sums.collect()) == len(ROWS)
    limits = [0, 1, 7, 45, sizes[-1] - 1, sizes[-1], sizes[-1] + 1]
    found = {r["context_limit"]: r for r in token_counts.at_limits(sums, limits).collect()}
    for x in limits:
        assert found[x]["kept_tokens"] == sum(min(s, x) for s in sizes)
        assert found[x]["cut_docs"] == sum(s > x for s in sizes) and found[x]["cut_tokens"] == sum(max(s - x, 0) for s in sizes)
    middle = {r["share"]: r["n_tokens"] for r in token_counts.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
    assert middle == {0.1: sizes[0], 0.5: sizes[len(sizes) // 2 - 1], 1.0: sizes[-1]}
    empty = token_counts.token_counts(none, path)
    assert empty.count() == 0
    assert [r["kept_tokens"] for r in token_counts.at_limits(empty, [5]).collect()] == [0]
    assert [r["n_tokens"] for r in token_counts.quantiles(empty, [0.5]).collect()] == [None]
