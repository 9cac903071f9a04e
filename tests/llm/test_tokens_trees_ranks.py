"""op11, op12 and op13 against plain versions."""

import collections
import hashlib
import math
import random
import re
import zlib

import pandas as pd
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tests.compare import SF, same
from townhall.llm import queries as corpus
from townhall.llm import ranked_search as ranks
from townhall.llm.byte_bpe import ByteBpe, decode_bpe, encode_bpe
from townhall.llm.merkle import folded, lower_ascii, manifest, proof_digest

BYTES = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BYTES)


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_bpe_fragments(library):
    """Contractions, white space of all kinds, marks, added tokens, and cuts between any of them."""
    rng = random.Random(5)
    parts = ["'", "s", "t", "re", "ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "　", " ", "a", "Q", "z", "é", "日", "த", "“", "”", "!", "?", "’", "1", "23", "_",
             "<|endoftext|>", "<|endof", "text|>", "|>", "́", "‍", "😀", "\x00", "\x7f", "don't", "I'll", " '"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(4000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x20, 0x3000), rng.randrange(0x10000, 0x1F900)])) for _ in range(rng.randrange(40))) for _ in range(2000)]
    bpe = ByteBpe(BYTES)
    ids, ends = bpe.encode(texts)
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:z].tolist() for a, z in zip(ends[:-1], ends[1:], strict=True)] == expected
    assert bpe.decode(ids, ends) == [library.decode(e, skip_special_tokens=False) for e in expected]
    _, cuts, _ = bpe.boundaries(["the quick, brown fox".encode()])
    assert len(cuts) > 4  # it is cut, not encoded whole


def test_bpe_forgets(library, monkeypatch):
    monkeypatch.setattr("townhall.llm.byte_bpe.REMEMBERED", 3)
    bpe = ByteBpe(BYTES)
    for text in ("one two three four", "two three", "four five six seven"):
        ids, _ = bpe.encode([text])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids


def test_bpe_refuses_others():
    with pytest.raises(ValueError, match="byte-level"):
        ByteBpe(P.path("word_bpe_49k.json"))


def test_encode_bpe(spark, library):
    long = "The quick brown fox's 12 jumps; aaaaaaaaaaaa\n" * 30_000 + "z" * 100_000
    rows = [(1, "one two"), (2, None), (2, None), (3, ""), (None, "x y"), (4, long), (5, "é日本 😀\x00<|endoftext|>"), (4, long), (6, " \n ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("packed", "decoded", "n_tokens", "text_hash")})
    encoded = encode_bpe(docs, BYTES)
    got = collections.Counter((r["doc_id"], r["n_tokens"], bytes(r["packed"]), r["decoded"]) for r in encoded.collect())
    ids = {t: library.encode(t, add_special_tokens=False).ids for t in {t or "" for _, t in rows}}
    pack = lambda x: b"".join(i.to_bytes(4, "little") for i in x)
    assert got == collections.Counter((i, len(ids[t or ""]), pack(ids[t or ""]), t or "") for i, t in rows)
    assert encode_bpe(docs.filter("false"), BYTES).count() == 0
    odd = [[50256, 5], [220, 100], [], [60000, 5], [0xFFFFFFFF]]
    packed = spark.createDataFrame([(i, pack(x) + b"\x01") for i, x in enumerate(odd)] + [(9, None)], "doc_id long, packed binary")
    back = {r["doc_id"]: r["decoded"] for r in decode_bpe(packed, BYTES).collect()}
    assert back == {i: library.decode([t for t in x if t < 50257], skip_special_tokens=False) for i, x in enumerate(odd)} | {9: ""}


def test_op12(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {tuple(r) for r in corpus.op12_byte_bpe(spark, SF).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()}
    expected = set()
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        expected.add((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), h(library.decode(ids, skip_special_tokens=False))))
    assert got == expected


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tree_of(nodes):
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for k in range(len(paths)):
            s = at[k] // 16 * 16
            paths[k].append((nodes[s : at[k]], nodes[at[k] + 1 : s + 16]))
            at[k] //= 16
        nodes = [h("".join(nodes[i : i + 16])) for i in range(0, len(nodes), 16)]
    return nodes[0], paths


def trees_by_force(rows):
    leaf = lambda r: h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    by = collections.defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    built = []
    for s in sorted(by, key=lambda s: (s is not None, (s or "").encode())):
        of = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        built.append((of, *tree_of([leaf(r) for r in of])))
    root, above = tree_of([b[1] for b in built])
    out = []
    for (of, sub, paths), up in zip(built, above, strict=True):
        for r, path in zip(of, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            f = leaf((*r[:4], lowered(r[4]))) if tampered else leaf(r)
            for a, b in path + up:
                f = h("".join(a) + f + "".join(b))
            out.append((r[0], leaf(r), sub, root, h("".join("".join(a) + "".join(b) for a, b in path + up)), f))
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "levels", "sources"), [(1, 3, 1), (700, 1, 3), (1500, 2, 40), (5000, 3, 2), (600, 1, 300)])
def test_manifest(spark, n, levels, sources):
    """Sources of all sizes, one of them hot; short last groups; trees of one to four rounds; nulls, ties and repeated rows."""
    rng = random.Random(n)
    pick = lambda v, p: None if rng.random() < p else v
    rows = [(pick(rng.randrange(2 * n), 0.01), pick(f"s{0 if rng.random() < 0.4 else rng.randrange(sources)}", 0.02), pick("l", 0.1), rng.randrange(9), pick(f"Ab É {rng.randrange(5)}", 0.05)) for _ in range(n)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=FIELDS, dtype=object), "doc_id long, source string, lang string, n_chars long, text string").withColumns({c: F.lit(1) for c in ("grp", "path", "n", "idx", "node")})
    proved = manifest(df, FIELDS, {"text": lower_ascii(F.col("text"))}, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, levels)
    got = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")), folded(F.coalesce("changed_leaf", "leaf"), F.col("path")))
    assert sorted(map(tuple, got.collect()), key=str) == trees_by_force(rows)


def test_manifest_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert manifest(empty, ["doc_id", "source", "text"]).count() == 0


def test_lower_ascii(spark):
    rows = spark.createDataFrame([("AbZ [É] İ",), ("AZ@[`",), (None,), ("",)], "t string")
    assert [r[0] for r in rows.select(lower_ascii(F.col("t"))).collect()] == ["abz [É] İ", "az@[`", None, ""]


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranks_by_force(docs, items, k):
    counted = [(i, collections.Counter(lowered(m) for m in TERM.findall(t or ""))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n, total, df = len(counted), sum(x[2] for x in counted), collections.Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) for t in {lowered(m) for m in TERM.findall(text or "")} if t in df}
        found = []
        for i, c, size in counted:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(w[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in w if t in c)
            if score > 0:
                found.append((-score, i is not None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize(("n", "n_items", "k", "shard", "words"), [(400, 12, 5, 2_000, 40), (300, 8, 50, 1 << 20, 500), (900, 10, 3, 400, 1_000), (1, 1, 5, 100, 1)])
def test_search(spark, monkeypatch, n, n_items, k, shard, words):
    """Many shards, which bounds skip; blocks of items; ties, nulls, repeated rows and a hot text."""
    monkeypatch.setattr(ranks, "SHARD_BYTES", shard)
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "Ab", "日本"]
    text = lambda size, weights: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(size)))
    falling = [1 / (i + 1) for i in range(len(vocabulary))]
    docs = [(None if rng.random() < 0.01 else rng.randrange(n), None if rng.random() < 0.03 else text(40, falling) if rng.random() < 0.7 else "w1 w2 Ab w9, w40") for _ in range(n)]
    items = [(i, text(14, None)) for i in range(n_items)] + [(99, None), (None, "w3 w5")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("item", "score", "rank", "shard")}).repartition(3)
    queries = spark.createDataFrame([*items, items[0]], "item_id long, text string").withColumn("doc_id", F.lit(0))
    got = ranks.search(df, queries, k, words).select("item_id", "rank", "doc_id", "score")
    assert sorted(map(tuple, got.collect()), key=str) == ranks_by_force(docs, items, k)
    assert ranks.search(df.filter("false"), queries, k).count() == 0 == ranks.search(df, queries.filter("false"), k).count()


def test_pair_bounds_skip():
    """Strong words that never meet: by their sum every document would be looked at, by their pair none but the best."""
    work = ranks.Workload([(1, [b"a", b"b"])])
    work.weigh(100, 1000, {0: 40, 1: 40})
    import numpy as np
    import pyarrow as pa

    docs = np.concatenate([np.arange(40), np.arange(40, 80)])
    impacts = np.concatenate([np.r_[np.full(5, 100), np.full(35, 60)], np.full(40, 60)])
    pairs, _, pair_docs, joint = ranks._intersect(work, np.array([0, 1]), np.array([0, 40, 80]), docs, impacts, 100)
    columns = ranks._lists(np.arange(100), np.array([0, 1], np.int32), np.array([0, 40, 80], np.int32), docs.astype(np.int32), impacts, pairs.astype(np.int32), np.zeros(1, np.int32), pair_docs.astype(np.int32), joint)
    batch = pa.RecordBatch.from_arrays(columns, ["ids", "terms", "starts", "docs", "impacts", "pairs", "pair_starts", "pair_docs", "joint"])
    shard = ranks._Shard(batch, 0, work)
    assert shard.bounds(0, np.array([0, 1]))[1].tolist() == [0, 60, 100]  # not 160
    best = ranks._Best(5, 101)
    assert shard.search(0, best) == 0 and not len(best.scores)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op13_ranked_search"])
def test_by_sql(spark, name):
    same(spark, corpus.queries()[name], corpus.oracle_sql()[name])


def test_secrets_of_one_text_with_many(spark):
    """60,000 spans in one text, candidates among them that overlap a base span, touch one, or stand alone."""
    from townhall.llm.secrets import redacted, secrets, span_text

    live = "aB3dE5fG7hJ9kL1mN2pQ"
    text = "".join(f"é password = abcdef{i:06d};" for i in range(60_000)) + f" {live}X token={live}Y {live}X\n"
    docs = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (2, None, "b")], "doc_id long, text string, source string")
    found = secrets(docs)
    rows = found.select("doc_id", F.size("base").alias("base"), span_text(F.col("added")).alias("added")).collect()
    at = [m.start() for m in re.finditer(f"{live}X", text)]
    assert sorted(map(tuple, rows)) == [(1, 60_001, ",".join(f"owned:{a}:{a + 21}" for a in at))] * 2 + [(2, 0, "")]
    spans = found.filter("doc_id = 1").limit(1).select(F.array_sort(F.concat("base", "added")).alias("s"))
    masked = docs.filter("doc_id = 1").limit(1).crossJoin(spans).select(redacted(F.col("text"), F.col("s"))).first()[0]
    assert masked == "é <secret>;" * 60_000 + " <secret> <secret> <secret>\n"


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_files_of_any_tokenizer(spark, tmp_path, name):
    """Ids are the library's, whether its file allows words to be encoded by themselves or not."""
    import json

    from tokenizers import Tokenizer

    from townhall.llm.token_files import goes_by_words, read_token_files, write_token_files

    with open(P.path(name)) as f:
        assert goes_by_words(json.load(f)) == (name == "word_bpe_49k.json")
    library = Tokenizer.from_file(P.path(name))
    rows = [(i, t) for i, t in enumerate(["The  Quick\nbrown fox's!", "", None, "Ünïcode İ x", "a<|endoftext|>b", "don't 12 34 — ok"])]
    write_token_files(spark.createDataFrame(rows, "doc_id long, text string"), P.path(name), f"file://{tmp_path}/t", end_id=7)
    got = {r["doc_id"]: r["ids"] for r in read_token_files(spark, f"file://{tmp_path}/t").collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 7] for i, t in rows}


@pytest.mark.parametrize("words", [1, 7, 60, 10_000])
def test_contamination_in_blocks(spark, words):
    """Blocks of any number of words come to the same rows; one block reads the benchmark at once."""
    from townhall.llm.decontamination import contamination

    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(8)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(25)] + [(90, None), (91, ""), (None, "w1 w2")]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 40)))) for i in range(40)] + [(100, None)]
    got = contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), window=4, block_words=words)
    expected = set()
    for i, text in docs:
        ws, hit, found = (text or "").split(), set(), set()
        for item, words_of in ((k, (t or "").split()) for k, t in items):
            n = min(4, len(words_of))
            grams = {tuple(words_of[k : k + n]) for k in range(len(words_of) - n + 1)} if n else set()
            at = [k for k in range(len(ws) - n + 1) if n and tuple(ws[k : k + n]) in grams]
            hit |= {p for k in at for p in range(k, k + n)}
            if at and item is not None:
                found.add(str(item))
        expected.add((i, len(ws), len(hit), tuple(sorted(found))))
    assert {(r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"])) for r in got.collect()} == expected
