"""Queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ember.llm import bagminhash, bloom_cascade, bpe, katz, line_runs, merkle, mixing, nn_descent, ordinal, periodic_runs, pivot_index, quotes, token_counts
from ember.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` and, when given, its SQL counterpart."""

    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


# --- 1: BPE encoding and decoding --------------------------------------------


@query("op1_bpe_words")
def op1(spark, sf_dir):
    """Encode and decode all documents through the distinct-word table."""
    path = public_tokenizers.path("word_bpe_49k.json")
    done = bpe.encode(table(spark, sf_dir, "documents"), path, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("packed", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


# --- 2: token counts ---------------------------------------------------------


@query("op2_token_counts")
def op2(spark, sf_dir):
    """Token counts of all documents by the whole-token shortcut."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


# --- 3: mixing ---------------------------------------------------------------

MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  md5(concat_ws('|','17',doc_id,md5(coalesce(text,'')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([3,1,2][CAST((row_number() OVER (ORDER BY encode(source) NULLS LAST)-1)%3 AS BIGINT)+1] AS DOUBLE) AS weight FROM s),
r AS (SELECT *, source_size*2.0::DOUBLE AS cap, source_size*2.0::DOUBLE/weight AS ratio FROM w),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM s)*1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0))
  / sum(weight) OVER (ORDER BY ratio, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev FROM r),
f AS (SELECT *, (SELECT lev FROM l WHERE lev<ratio ORDER BY ratio LIMIT 1) AS fill FROM l),
t AS (SELECT source, source_size, CASE WHEN lev>=ratio THEN cap ELSE weight*fill END AS target FROM f),
g AS (SELECT *, CASE WHEN source_size>0 THEN CAST(floor(target/source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
b AS (SELECT d.*, g.source_size, g.target, g.whole, CAST(round(target) AS BIGINT)-whole*source_size AS residue,
  coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, round(target,6) AS target, CAST(whole*size+least(size, greatest(0, residue-before)) AS BIGINT) AS taken FROM b
"""


@query("op3_mix_sources", MIX_SQL)
def op3(spark, sf_dir):
    """Capped water-filling over all documents; weights 3, 1, 2 and at most 2 epochs."""
    out = mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), share=1.5, max_epochs=2.0)
    return out.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


# --- 4: chat formatting ------------------------------------------------------

QUOTE_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY ALL),
q AS (SELECT conv_id, turn, CAST(conv_id AS VARCHAR)||'-'||CAST(turn AS VARCHAR) AS msg_id, CASE WHEN trim(coalesce(text,''))='' THEN '' ELSE text END AS own_text,
  trim(regexp_replace(lower(lag(text,1) OVER w),'\s+',' ','g')) AS q1, trim(regexp_replace(lower(lag(text,2) OVER w),'\s+',' ','g')) AS q2
  FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, trim(regexp_replace(lower(unnest([own_text]||string_split_regex(own_text,'\n\s*\n')||string_split(own_text,chr(10)))),'\s+',' ','g')) AS piece FROM q),
f AS (SELECT conv_id, piece, min(turn) AS turn FROM p WHERE length(piece)>0 GROUP BY ALL),
l AS (SELECT q.*, f1.turn AS t1, f2.turn AS t2 FROM q LEFT JOIN f f1 ON f1.conv_id=q.conv_id AND f1.piece=q.q1 AND f1.turn<q.turn
  LEFT JOIN f f2 ON f2.conv_id=q.conv_id AND f2.piece=q.q2 AND f2.turn<q.turn),
r AS (SELECT msg_id, turn, own_text, CASE WHEN coalesce(q2,'')<>'' THEN 2 WHEN coalesce(q1,'')<>'' THEN 1 ELSE 0 END AS quote_levels,
  CAST(coalesce(length(q1)>0,false) AS BIGINT)+CAST(coalesce(length(q2)>0,false) AS BIGINT) AS n_quotes,
  CAST(t1 IS NOT NULL AS BIGINT)+CAST(t2 IS NOT NULL AS BIGINT) AS n_linked,
  CASE WHEN coalesce(t1,t2) IS NOT NULL THEN CAST(conv_id AS VARCHAR)||'-'||CAST(coalesce(t1,t2) AS VARCHAR) END AS parent_id FROM l),
u AS (SELECT msg_id, msg_id AS root_id, CAST(0 AS BIGINT) AS depth FROM r WHERE parent_id IS NULL
  UNION ALL SELECT r.msg_id, u.root_id, u.depth+1 FROM r JOIN u ON r.parent_id=u.msg_id)
SELECT r.msg_id, r.turn AS position, own_text, quote_levels, n_quotes, n_linked, parent_id, root_id, depth,
 CAST(row_number() OVER (PARTITION BY root_id ORDER BY depth, r.turn, r.msg_id) AS INTEGER) AS reply_order FROM r JOIN u ON r.msg_id=u.msg_id
"""


@query("op4_quote_links", QUOTE_SQL)
def op4(spark, sf_dir):
    """Reply-ordered conversations of all turns, written as mail that quotes what it answers."""
    mail = quotes.as_mail(table(spark, sf_dir, "conversations"))
    return quotes.thread(quotes.link_quotations(mail, group="conv_id"))


# --- 5: approximate nearest neighbours ---------------------------------------


@query("op5_nn_descent")
def op5(spark, sf_dir):
    """Ten nearest found of every 100th vector, all rows being candidates."""
    return nn_descent.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


# --- 6: LM scoring -----------------------------------------------------------


@query("op6_katz_scores")
def op6(spark, sf_dir):
    """Katz and add-0.1 scores of all documents, learned from nine tenths of them."""
    return katz.score_texts(table(spark, sf_dir, "documents"))


# --- 7: quality classifier ---------------------------------------------------


@query("op7_ordinal_quality")
def op7(spark, sf_dir):
    """Expected grade and top-grade probability of all documents."""
    docs = table(spark, sf_dir, "documents")
    model = ordinal.train(docs, table(spark, sf_dir, "labels"))
    return ordinal.grade_documents(docs, model).select("doc_id", "expected_grade", "tail", "keep")


# --- 8: URL filters ----------------------------------------------------------

# Rules and the labels of listed hosts.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
LISTED = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]

_WHEN = " ".join(
    f"WHEN (host='{h}' OR ends_with(host,'.{h}')) AND starts_with(path,'/{p}') THEN {{{i}}}"
    for i, (h, _, p) in sorted(enumerate([r[1].partition("/") for r in RULES]), key=lambda x: -len("".join(x[1])))
)
URL_SQL = rf"""
WITH p AS (SELECT page_id, CASE WHEN contains(url,'://') THEN substr(url, strpos(url,'://')+3) ELSE '' END AS r FROM pages),
h AS (SELECT page_id, translate(regexp_extract(r,'^([^/?#]*)',1),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r,'^[^/?#]*([^?#]*)',1) AS path FROM p)
SELECT page_id, host, path, CASE {_WHEN.format(*[f"'{r[1]}'" for r in RULES])} END AS rule,
 CASE {_WHEN.format(*[f"'{r[0]}'" for r in RULES])} WHEN regexp_matches(host,'(^|\.)({"|".join(LISTED)})\.') THEN 'block' ELSE 'allow' END AS verdict FROM h
"""


@query("op8_bloom_cascade", URL_SQL)
def op8(spark, sf_dir):
    """All page URLs against the rules and a cascade over all hosts."""
    listed = F.col("key").rlike(r"(^|\.)(" + "|".join(LISTED) + r")\.")
    return bloom_cascade.filter_urls(table(spark, sf_dir, "pages"), RULES, listed)


# --- 9: exact top-k search ---------------------------------------------------

TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256*CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x)))=0 AND len(embedding)>0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query("op9_pivot_topk", TOP_SQL)
def op9(spark, sf_dir):
    """Five best whole-number inner products of every 50th vector against all rows."""
    return pivot_index.top_inner_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


# --- 10: near duplicates -----------------------------------------------------


@query("op10_bag_minhash")
def op10(spark, sf_dir):
    """Near-duplicate class of every document; five words, similarity 0.8.

    ``class_key`` tells apart classes with the same smallest id.
    """
    key = F.coalesce("root", F.xxhash64("node", "doc_id")).alias("class_key")
    return bagminhash.near_duplicates(table(spark, sf_dir, "documents"), threshold=0.8).select("doc_id", "class_id", key)


# --- 11: line dedup ----------------------------------------------------------

LINE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text,''), chr(10)) AS l FROM documents),
e AS (SELECT rid, doc_id, unnest(l) AS line, generate_subscripts(l,1) AS n FROM d),
k AS (SELECT *, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz') AS key FROM e),
f AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key)>=40 GROUP BY key HAVING count(DISTINCT rid)>=5),
m AS (SELECT k.*, f.key IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM k LEFT JOIN f ON f.key=k.key)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone),'')) AS kept_sha256 FROM m GROUP BY rid
"""


@query("op11_line_runs", LINE_SQL)
def op11(spark, sf_dir):
    """Lines of at least 40 code points in at least 5 documents dropped but in the largest doc_id."""
    done = line_runs.drop_repeated_lines(table(spark, sf_dir, "documents"), shortest=40, least=5)
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


# --- 12: periodic runs -------------------------------------------------------


@query("op12_periodic_runs")
def op12(spark, sf_dir):
    """Runs of all documents, every tenth with a repeated tail, and digests of runs and collapsed texts."""
    done = periodic_runs.find_runs(periodic_runs.repeat_tails(table(spark, sf_dir, "documents")))
    best = periodic_runs.strongest(F.col("runs"))
    line = lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))
    done = done.withColumn("best", best)
    return done.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


# --- 13: Merkle manifest -----------------------------------------------------

# crc32 of the decimal id, bit by bit
_CRC = (
    "xor(list_reduce([4294967295::BIGINT]||list_transform(string_split(CAST(doc_id AS VARCHAR),''), lambda c: CAST(ascii(c) AS BIGINT)),"
    " lambda a,b: list_reduce([xor(a,b),0,0,0,0,0,0,0,0], lambda x,z: CASE WHEN x&1=1 THEN xor(x>>1,3988292384) ELSE x>>1 END)), 4294967295)"
)


def _leaf_sql(text: str) -> str:
    fields = ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)
    return "sha256(" + "||".join(f"coalesce(CAST(strlen({f}) AS VARCHAR)||':'||{f},'-')" for f in fields) + ")"


def _tree_sql(name: str, depth: int) -> str:
    """Levels of a forest over ``{name}0 (g, idx, c, h)`` and its tops."""
    steps = [
        f"{name}r{k} AS (SELECT g, idx//16 AS idx, c, list(h ORDER BY idx) AS l FROM {name}{k} WHERE c>1 GROUP BY g, idx//16, c),"
        f"{name}{k + 1} AS (SELECT g, idx, (c+15)//16 AS c, sha256(array_to_string(l,'')) AS h FROM {name}r{k})"
        for k in range(depth)
    ]
    tops = " UNION ALL ".join(f"SELECT g, h FROM {name}{k} WHERE c=1" for k in range(depth + 1))
    return ",\n".join(steps) + f",\n{name}top AS ({tops})"


def _fold_sql(name: str, source: str, group: str, at: str, depth: int) -> str:
    """Siblings and folds of the leaves up one forest, level by level."""
    steps = []
    for k in range(depth):
        own = f"({at}>>{4 * k})&15"
        steps.append(
            f"{name}f{k} AS (SELECT x.* REPLACE (CASE WHEN l IS NULL THEN sib ELSE sib||array_to_string(l[:{own}]||l[({own})+2:],'') END AS sib,"
            f" CASE WHEN l IS NULL THEN fold ELSE sha256(array_to_string(l[:{own}]||[fold]||l[({own})+2:],'')) END AS fold)"
            f" FROM {source} x LEFT JOIN {name}r{k} r ON r.g={group} AND r.idx={at}>>{4 * (k + 1)})"
        )
        source = f"{name}f{k}"
    return ",\n".join(steps)


MERKLE_SQL = f"""
WITH d AS (SELECT doc_id, source, {_leaf_sql("text")} AS leaf, CASE WHEN {_CRC}%5=0
  THEN {_leaf_sql("translate(text,'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS shown FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf)-1 AS pos, count(*) OVER (PARTITION BY source) AS n,
  dense_rank() OVER (ORDER BY encode(source) NULLS FIRST)-1 AS s FROM d),
a0 AS (SELECT s AS g, pos AS idx, n AS c, leaf AS h FROM p),
{_tree_sql("a", 7)},
b0 AS (SELECT 0 AS g, g AS idx, count(*) OVER () AS c, h FROM atop),
{_tree_sql("b", 5)},
p0 AS (SELECT doc_id, leaf, s, pos, '' AS sib, shown AS fold FROM p),
{_fold_sql("a", "p0", "x.s", "x.pos", 7)},
{_fold_sql("b", "af6", "0", "x.s", 5)}
SELECT doc_id, leaf, atop.h AS subroot, btop.h AS root, sha256(sib) AS proof_sha256, fold AS folded_root, fold=btop.h AS verified
 FROM bf4 x JOIN atop ON atop.g=x.s CROSS JOIN btop
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13(spark, sf_dir):
    """Leaf, roots, proof digest and fold of all documents, every fifth presented with A-Z lower-cased."""
    docs = table(spark, sf_dir, "documents")
    done = merkle.manifest(docs, merkle.lowered_text(docs))
    return done.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("proof", ""), 256).alias("proof_sha256"), "folded_root", "verified")
