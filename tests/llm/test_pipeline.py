import public_tokenizers as P
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from tests.compare import SF
from tests.llm.test_operators import base_spans, groups_by_force
from townhall.llm.decontamination import words_of
from townhall.llm.language_id import CONFIDENT, has_letter, train_language_model, windows_of


def known(model, text):
    """Whether the network, window by window, knows the language of a text."""
    windows = [w for w in windows_of((text or "").encode()) if has_letter(w)]
    if not windows:
        return False
    return (sum(model.probabilities([w])[0] for w in windows) / sum(map(len, windows))).max() >= CONFIDENT


def is_contaminated(text, items):
    ws = words_of(text)
    hit = set()
    for item in items:
        n = min(13, len(item))
        windows = {tuple(item[k : k + n]) for k in range(len(item) - n + 1)} if n else set()
        for k in range(len(ws) - n + 1 if n else 0):
            if tuple(ws[k : k + n]) in windows:
                hit |= set(range(k, k + n))
    return bool(hit) and 20 * len(hit) >= len(ws)


def masked(text):
    out, at = "", 0
    for start, _, end in base_spans(text):
        if end <= at:
            continue
        out, at = out + (text[at:start] + "<secret>" if start >= at else ""), end
    return out + text[at:]


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = train_language_model(docs)
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if known(model, t)}
    groups = groups_by_force(sorted(rows.items()), corpus_pipeline.NEAR)
    rows = {i: t for i, t in rows.items() if groups[i][1] == i}
    items = [words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not is_contaminated(t, items)}
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    expected = {i: sp.encode(masked(t)) for i, t in rows.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"]: list(r["piece_ids"]) for r in got} == expected
    assert len(got) == len(expected) and all(r["same"] for r in got)


def test_stages_keep_odd_rows(spark):
    rows = [(1, None), (None, "some words of plain english text here"), (2, ""), (3, "token = abcdefgh the rest of this text is english"), (3, "token = abcdefgh the rest of this text is english")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit(None).cast("string"), "n_chars": F.length("text").cast("long"), "spans": F.lit(1), "g_id": F.lit(2)})
    columns = corpus_pipeline.COLUMNS
    assert corpus_pipeline.no_secrets(spark, docs, SF).select(*columns).filter("text like '<secret> the%'").count() == 2
    assert corpus_pipeline.one_of_copies(spark, docs, SF).count() == 4  # the repeated row is there once
    assert corpus_pipeline.no_benchmark(spark, docs, SF).count() == 5
    assert corpus_pipeline.known_language(spark, docs, SF).filter("text is null or text = ''").count() == 0
    assert corpus_pipeline.pieces(spark, docs, SF).filter("same").count() == 5
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0, name
