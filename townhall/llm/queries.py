"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from townhall.llm.byte_bpe import encode_bpe
from townhall.llm.common import fresh_path, learn_split
from townhall.llm.conversations import format_chats
from townhall.llm.decontamination import contaminated, contamination
from townhall.llm.language_id import predict_language, train_language_model
from townhall.llm.merkle import folded, lower_ascii, manifest, proof_digest
from townhall.llm.near_dup import near_duplicates
from townhall.llm.nearest import nearest
from townhall.llm.ranked_search import search
from townhall.llm.secrets import CANDIDATE, KINDS, ORDER, secrets, span_text
from townhall.llm.token_counts import token_counts
from townhall.llm.token_files import token_ranges, write_token_files
from townhall.llm.toxicity import score_toxicity, train_toxicity
from townhall.llm.transducer import round_trip

TOKEN_LIMIT = 4096
TOXIC_FROM = 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


OP2_SQL = r"""
with d as (
  select row_number() over () rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from documents),
b as (
  select item_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') ws
  from benchmark where text is not null),
w as (
  select distinct item_id, n, array_to_string(ws[p:p + n - 1], ' ') g
  from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) p from (select *, least(13, len(ws)) n from b where len(ws) > 0))),
g as (
  select rid, n, p, array_to_string(ws[p:p + n - 1], ' ') g
  from (select rid, ws, n, unnest(range(1, len(ws) - n + 2)) p from d, (select distinct n from w))),
m as (select rid, n, p, item_id from g join w using (n, g)),
h as (select rid, count(distinct q) n_hit from (select rid, unnest(range(p, p + n)) q from m) group by rid),
i as (select rid, count(distinct item_id) n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) s from m group by rid)
select doc_id, len(ws)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
  sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) contaminated
from d left join h using (rid) left join i using (rid)
"""


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", learn_split("doc_id").alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


OP4_SQL = r"""
with recursive d as (
  select row_number() over () rid, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') ws
  from documents),
s as (select distinct rid, array_to_string(ws[p:p + 4], ' ') g from (select rid, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) p from d where len(ws) > 0)),
n as (select rid, count(*) n from s group by rid),
c as (select a.rid x, b.rid y, count(*) c from s a join s b on a.g = b.g and a.rid < b.rid group by 1, 2),
l as (select x, y from c join n p on p.rid = x join n q on q.rid = y where 100 * c >= 85 * (p.n + q.n - c)),
e as (select x a, y b from l union select y, x from l),
walk as (select rid, rid seen from d union select w.rid, e.b from walk w join e on e.a = w.seen),
r as (select w.rid, min(o.doc_id) component_id from walk w join d o on o.rid = w.seen group by w.rid)
select doc_id, coalesce(n, 0)::bigint n_shingles, component_id, doc_id is not distinct from component_id kept from d join r using (rid) left join n using (rid)
"""


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


OP5_SQL = """
with t as (select distinct conv_id, turn, role, text from conversations where conv_id is not null),
c as (
  select conv_id, count(*) n_turns, list({'r': role, 't': text} order by turn nulls last, role nulls last, text nulls last) turns,
    string_agg('<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || chr(10)
      || replace(replace(coalesce(text, ''), '<|im_start|>', '<im_start>'), '<|im_end|>', '<im_end>') || '<|im_end|>' || chr(10), ''
      order by turn nulls last, role nulls last, text nulls last) chat
  from t group by conv_id),
u as (select turns, min(conv_id) conv_id, count(*) copies, any_value(n_turns) n_turns, any_value(chat) chat from c group by turns)
select conv_id, n_turns, copies, chat from u a
where not exists (select 1 from u b where b.n_turns > a.n_turns and b.turns[1] = a.turns[1] and b.turns[1:a.n_turns] = a.turns)
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets(table(spark, sf_dir, "documents"))
    of = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == ORDER.index(kind))).cast("long")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        F.col("copied").cast("long").alias("n_copied"),
    )


def _spans_sql(kind: int, name: str, pattern: str, group: int, least: int, more: str = "true") -> str:
    return f"""select rid, {kind} kind, '{name}' nm, st, st + length(f) til, v from (
      select rid, found[i] f, vals[i] v, coalesce(list_sum(list_transform(pieces[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) st
      from (select rid, string_split_regex(t, '{pattern}') pieces, regexp_extract_all(t, '{pattern}', 0) found, regexp_extract_all(t, '{pattern}', {group}) vals, unnest(range(1, len(found) + 1)) i from d))
      where length(v) >= {least} and {more}"""


_RANDOM = "regexp_matches(v, '[0-9].*[0-9].*[0-9]') and regexp_matches(v, '[a-z]') and regexp_matches(v, '[A-Z]') and 2 * len(list_distinct(string_split(v, ''))) >= least(length(v), 40)"
_BASE = " union all ".join(_spans_sql(i, k, p.replace("'", "''"), g, n) for i, (k, (p, n, g)) in enumerate(KINDS.items()))
OP6_SQL = f"""
with d as (select row_number() over () rid, doc_id, coalesce(source, '') as owner, coalesce(text, '') t from documents),
b as ({_BASE}),
c as ({_spans_sql(3, 'owned', CANDIDATE, 0, 20, _RANDOM)}),
a as (select * from b union all select * from c),
o as (select v, count(distinct owner) <= 1 and count(distinct t) <= 5 live from a join d using (rid) group by v),
x as (select rid, kind, nm, st, til from c join o using (v) where live and not exists (select 1 from b where b.rid = c.rid and b.til > c.st and b.st < c.til)),
s as (select rid, string_agg(nm || ':' || st || ':' || til, ',' order by st, kind, til) all_spans from (select rid, kind, nm, st, til from b union all select * from x) group by rid),
f as (select rid, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex, string_agg(nm || ':' || st || ':' || til, ',' order by st, kind, til) base_spans from b group by rid),
k as (select rid, count(*) n from (select distinct rid, kind, st, til from a join o using (v) where not live) group by rid)
select doc_id, coalesce(n_assign, 0)::bigint n_assign, coalesce(n_access, 0)::bigint n_access, coalesce(n_hex, 0)::bigint n_hex, sha256(coalesce(base_spans, '')) base_sha256,
  coalesce(all_spans, '') spans, coalesce(k.n, 0)::bigint n_copied
from d left join f using (rid) left join s using (rid) left join k using (rid)
"""


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = predict_language(docs.select("doc_id", "text"), train_language_model(docs.select("doc_id", "text", "lang")))
    return found.select("doc_id", learn_split("doc_id").alias("held_out"), "lang_pred", "score")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path)
    return token_ranges(spark, path)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


LEAF_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    proved = manifest(table(spark, sf_dir, "documents"), LEAF_FIELDS, {"text": lower_ascii(F.col("text"))}, tampered)
    root = folded(F.coalesce("changed_leaf", "leaf"), F.col("path"))
    out = proved.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), root.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"case when {c} is null then '-' else strlen({c}::varchar) || ':' || {c} end" for c in (*LEAF_FIELDS[:-1], text)) + ")"


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CRC = "xor(4294967295, list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint), lambda acc, c: list_reduce(range(8), lambda a, i: xor(a >> 1, 3988292384 * (a & 1)), xor(acc, c)), 4294967295::bigint))"
OP11_SQL = f"""
with recursive l as (select row_number() over () rid, doc_id, source, {_leaf_sql('text')} leaf, case when doc_id is not null and {_CRC} % 5 = 0 then {_leaf_sql(_LOWERED)} end changed from documents),
o as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 i, count(*) over (partition by source) n from l),
s as (select source, n, row_number() over (order by source nulls first) - 1 g, count(*) over () gn from (select distinct source, n from o)),
up as (
  select 0 lv, g, i, leaf h, n from o join s using (n) where o.source is not distinct from s.source
  union all
  select lv + 1, g, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from up where n > 1 group by lv, g, i // 16, n),
sub as (select g, h subroot, lv height from up where n = 1),
top as (
  select 0 lv, g i, subroot h, (select count(*) from s) n from sub
  union all
  select lv + 1, i // 16, sha256(string_agg(h, '' order by i)), (n + 15) // 16 from top where n > 1 group by lv, i // 16, n),
nodes as (
  select g, lv, i, h from up where n > 1
  union all select sub.g, height + top.lv, top.i, top.h from sub join top on top.n > 1),
own as (
  select rid, s.g, o.i, s.g gi, height, coalesce(changed, leaf) f from o join s on s.source is not distinct from o.source join sub on sub.g = s.g),
places as (
  select rid, g, f, height, lv, case when lv < height then i // (16 ** lv)::bigint else gi // (16 ** (lv - height))::bigint end p from own join (select distinct g, lv from nodes) using (g)),
runs as (
  select rid, f, a.lv, string_agg(h, '' order by b.i) filter (b.i < p) bef, string_agg(h, '' order by b.i) filter (b.i > p) aft
  from places a join nodes b on b.g = a.g and b.lv = a.lv and b.i // 16 = p // 16 group by rid, f, a.lv),
proof as (select rid, sha256(string_agg(coalesce(bef, '') || coalesce(aft, ''), '' order by lv)) proof, list({{'b': coalesce(bef, ''), 'a': coalesce(aft, '')}} order by lv) steps from runs group by rid),
fold as (
  select rid, f h, 1 k from own
  union all select rid, sha256(steps[k].b || h || steps[k].a), k + 1 from fold join proof using (rid) where k <= len(steps)),
done as (select rid, max_by(h, k) folded_root from fold group by rid)
select doc_id, leaf, subroot, h root, coalesce(proof, sha256('')) proof_sha256, folded_root, folded_root = h verified
from o join s on s.source is not distinct from o.source join sub using (g) join top on top.n = 1 join done using (rid) left join proof using (rid)
"""


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return encoded.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=50)


_TERMS = rf"regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
with d as (select row_number() over () rid, doc_id, {_TERMS} ws from documents where text is not null),
t as (select rid, term, count(*) tf from (select rid, unnest(ws) term from d) group by rid, term),
n as (select rid, sum(tf)::bigint n from t group by rid),
g as (select count(*)::bigint docs, sum(n)::bigint total from n),
w as (select term, floor(1000 * ln((2 * docs + 2)::double / (2 * df + 1)))::bigint w from (select term, count(*) df from t group by term), g),
m as (select rid, 50 + (50 * n * docs) // total m from n, g),
b as (select row_number() over () bid, item_id, text from (select distinct item_id, text from benchmark where text is not null)),
q as (select distinct bid, term from (select bid, unnest({_TERMS}) term from b)),
s as (select bid, rid, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::bigint score from q join w using (term) join t using (term) join m using (rid) group by bid, rid)
select item_id, row_number() over (partition by bid order by score desc, doc_id nulls first)::int as "rank", doc_id, score
from s join d using (rid) join b using (bid) where score > 0 qualify "rank" <= 50
"""


def queries() -> dict:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_decontamination": op2_decontamination,
        "op3_toxicity": op3_toxicity,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_chat_format": op5_chat_format,
        "op6_secret_scan": op6_secret_scan,
        "op7_nearest": op7_nearest,
        "op8_language_id": op8_language_id,
        "op9_token_files": op9_token_files,
        "op10_sentencepiece": op10_sentencepiece,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_ranked_search": op13_ranked_search,
    }


def oracle_sql() -> dict:
    return {"op2_decontamination": OP2_SQL, "op4_near_duplicates": OP4_SQL, "op5_chat_format": OP5_SQL, "op6_secret_scan": OP6_SQL, "op11_merkle_manifest": OP11_SQL, "op13_ranked_search": OP13_SQL}
