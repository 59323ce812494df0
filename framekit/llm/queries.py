"""One registered query for each operator, and its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framekit.llm import crc_sql, decontaminate, language_id, lm_score, mixing, near_dup, pii, quality, sharding, topk, url_rules
from framekit.llm.common import spread_hash

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Quality


@_query()
def op1_quality(spark, d):
    """Every document with its weak label, its score and whether it is accepted."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return quality.classify(docs, quality.train(docs), keep=["doc_id"])


# Sharding

SHARDS = 16

_COST = "{{'cost': -ln((('0x' || substr(md5(key || '|' || {s}), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE), 'shard': {s}}}"


@_query(
    f"""WITH d AS (SELECT doc_id, COALESCE(doc_id::VARCHAR, '') AS key, (octet_length(encode(COALESCE(text, ''))) + 1)::BIGINT AS size,
    ({crc_sql.crc32("encode(COALESCE(text, ''))")})::BIGINT AS text_crc32 FROM documents),
s AS (SELECT *, list_sort([{", ".join(_COST.format(s=s) for s in range(SHARDS))}])[1].shard AS shard, list_sort([{", ".join(_COST.format(s=s) for s in range(SHARDS + 1))}])[1].shard AS grown_shard,
    substr(md5(COALESCE(doc_id::VARCHAR, '-') || ':' || text_crc32 || ':' || size), 1, 15) AS digits FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY digits, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, grown_shard::INT AS grown_shard FROM s"""
)
def op2_sharding(spark, d):
    """All documents into equal shards by their id; law ``key``."""
    text = F.coalesce("text", F.lit(""))
    docs = table(spark, d, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law")
    )
    equal = [(s, 1.0) for s in range(SHARDS + 1)]
    placed = sharding.with_slots(sharding.shard(docs, "doc_id", equal[:SHARDS]), ["doc_id", "text_crc32", "size"])
    return sharding.shard(placed, "doc_id", equal, "grown_shard")


# Mixing

#: Slots of each named source and of all others together.
MIX, MIX_OTHER = {"src0": 20.0, **{f"src{i}": 5.0 for i in range(1, 16)}}, 5.0


def _mix_sql() -> str:
    """The schedule by a recursive step for each block: of the released sources, the one with the earliest deadline."""
    names = sorted(MIX)
    weights = [int(MIX[n]) for n in names] + [int(MIX_OTHER)]
    pool = "CASE source " + " ".join(f"WHEN '{n}' THEN {i + 1}" for i, n in enumerate(names)) + f" ELSE {len(weights)} END"
    each = f"range(1, {len(weights) + 1})"
    zeros = f"list_transform({each}, lambda i: 0::BIGINT)"
    deadline = "ceil((ran[i] + 1) * total / w[i])::BIGINT"
    return f"""WITH RECURSIVE d AS (SELECT doc_id, source, {pool} AS pool, md5(text) AS text_md5 FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY substr(md5(COALESCE(doc_id::VARCHAR, '-') || ':' || COALESCE(text_md5, '-')), 1, 15), doc_id NULLS FIRST, text_md5 NULLS FIRST) - 1 AS rank FROM d),
n AS (SELECT list_transform({each}, lambda i: COALESCE(list_filter(list({{'pool': pool, 'n': n}}), lambda x: x.pool = i)[1].n, 0)) AS n, {weights}::BIGINT[] AS w
  FROM (SELECT pool, COUNT(*) AS n FROM d GROUP BY pool)),
b AS (SELECT n, w, list_transform(n, lambda x: (x + 99) // 100) AS blocks FROM n),
s AS (SELECT 0::BIGINT AS slot, 0::BIGINT AS first, {zeros} AS done, {zeros} AS ran, 0::BIGINT AS pick, 0::BIGINT AS block, 0::BIGINT AS ahead FROM b
  UNION ALL
  SELECT slot + 1, CASE WHEN done[p] + 1 = blocks[p] THEN slot + 1 ELSE first END, list_transform(done, lambda x, i: x + (i = p)::BIGINT),
    CASE WHEN done[p] + 1 = blocks[p] THEN {zeros} ELSE list_transform(ran, lambda x, i: x + (i = p)::BIGINT) END, p, done[p], least(100, n[p] - 100 * done[p])
  FROM (SELECT *, list_min(list_transform(list_filter({each}, lambda i: done[i] < blocks[i] AND floor(ran[i] * total / w[i]) <= slot - first), lambda i: {deadline} * 1000 + i)) % 1000 AS p
    FROM (SELECT s.*, b.*, list_sum(list_transform({each}, lambda i: CASE WHEN done[i] < blocks[i] THEN w[i] ELSE 0 END)) AS total FROM s, b WHERE slot < list_sum(blocks)))),
l AS (SELECT pick, block, slot - 1 AS slot, SUM(ahead) OVER (ORDER BY slot) - ahead AS start FROM s WHERE pick > 0)
SELECT doc_id, source, l.block::BIGINT AS block, l.slot::BIGINT AS slot, (l.start + r.rank % 100)::BIGINT AS position FROM r JOIN l ON l.pick = r.pool AND l.block = r.rank // 100"""


@_query(_mix_sql())
def op3_mixing(spark, d):
    """The place of every document in a mixture of its sources."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.md5("text").alias("text_md5"))
    key = ["doc_id", "text_md5"]
    return mixing.mix(docs, "source", MIX, MIX_OTHER, key, hashed=spread_hash([F.col(c) for c in key])).drop("text_md5")


# URL rules

RULES = [
    url_rules.Rule("block", "net", "/"),
    url_rules.Rule("allow", "example.net", "/en/"),
    url_rules.Rule("block", "example.com", "/de/"),
    url_rules.Rule("allow", "org", "/fr/"),
]


def _rules_sql() -> str:
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    ordered = sorted(RULES, key=lambda r: -len(r.name))
    case = lambda value: "CASE " + " ".join(f"WHEN {fits(r)} THEN '{value(r)}'" for r in ordered)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH a AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{upper}', '{lower}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a)
SELECT page_id, host, path, {case(lambda r: r.name)} END AS rule, {case(lambda r: r.verdict)} ELSE 'allow' END AS verdict FROM b"""


@_query(_rules_sql())
def op4_url_filter(spark, d):
    """Every page's URL under the rules; what no rule fits is allowed."""
    return url_rules.judge(table(spark, d, "pages").select("page_id", "url"), "url", RULES, keep=["page_id"])


def _fold(n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id is the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


# Near duplicates


_TOKENS = r"list_filter(regexp_split_to_array(lower(COALESCE(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@_query(
    f"""WITH RECURSIVE u AS (SELECT row_number() OVER () AS id, text, MIN(doc_id) AS first, any_value({_TOKENS}) AS tokens FROM documents WHERE text IS NOT NULL GROUP BY text),
r AS (SELECT id, unnest(CASE WHEN len(tokens) <= 5 THEN [array_to_string(tokens, ' ')] ELSE list_transform(range(1, len(tokens) - 3), lambda i: array_to_string(tokens[i:i + 4], ' ')) END) AS run
  FROM u WHERE len(tokens) > 0),
s AS (SELECT id, run, COUNT(*) AS n FROM r GROUP BY id, run),
t AS (SELECT id, SUM(n) AS total FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, SUM(least(a.n, b.n)) AS common FROM s a JOIN s b ON a.run = b.run AND a.id < b.id GROUP BY a.id, b.id),
l AS (SELECT a, b FROM c JOIN t x ON x.id = a JOIN t y ON y.id = b WHERE common::DOUBLE / (x.total + y.total - common)::DOUBLE >= 0.8::DOUBLE),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k AS (SELECT id, first, first AS low FROM u UNION SELECT y.id, y.first, k.low FROM k JOIN e ON e.a = k.id JOIN u y ON y.id = e.b),
g AS (SELECT id, MIN(low) AS class_id FROM k GROUP BY id)
SELECT doc_id, COALESCE(class_id, doc_id) AS class_id FROM documents LEFT JOIN u USING (text) LEFT JOIN g USING (id)"""
)
def op5_near_dup(spark, d):
    """Every document with the id of its class of near copies, the smallest document id in it."""
    return near_dup.with_classes(table(spark, d, "documents"), keep=("doc_id",))


# Decontamination


@_query(
    rf"""WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_TOKENS} AS tokens FROM documents),
i AS (SELECT row_number() OVER () AS item, item_id, {_TOKENS} AS tokens FROM benchmark),
p AS (SELECT row, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS at FROM d),
q AS (SELECT item, least(len(tokens), 13) AS size, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS at FROM i),
m AS (SELECT row, item, size, q.at, p.at - q.at AS shift FROM p JOIN q USING (token)),
g AS (SELECT row, item, shift, CASE WHEN size < 11 THEN size ELSE size - least(2, size // 6) END AS least_equal FROM m GROUP BY row, item, shift, size
  HAVING COUNT(*) >= CASE WHEN size < 11 THEN size ELSE size - least(2, size // 6) END),
w AS (SELECT m.row, m.item, least_equal, COUNT(*) OVER (PARTITION BY m.row, m.item, m.shift ORDER BY m.at RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS equal
  FROM m JOIN g ON m.row = g.row AND m.item = g.item AND m.shift = g.shift)
SELECT doc_id, item_id, MAX(equal)::INT AS matched FROM w JOIN d USING (row) JOIN i USING (item) WHERE equal >= least_equal GROUP BY doc_id, item_id"""
)
def op6_decontamination(spark, d):
    """Every overlap of a document with a benchmark item."""
    found = decontaminate.overlaps(table(spark, d, "documents"), table(spark, d, "benchmark"))
    return found.groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"))


# Language model


@_query()
def op7_lm_score(spark, d):
    """Every document under the class model of the documents outside fold 2 of 7."""
    docs = table(spark, d, "documents").select("doc_id", "text", (_fold(7) == 2).alias("held_out"))
    model, head, counts = lm_score.fit(docs.where(~F.col("held_out")).select("text"))
    return lm_score.score(docs, model, head, counts, keep=["doc_id", "held_out"])


# Language


@_query()
def op8_language(spark, d):
    """Every document's language; learned from the documents outside fold 2 of 4."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", (_fold(4) == 2).alias("held_out"))
    model = language_id.train(docs.where(~F.col("held_out")))
    return language_id.predict(docs, model, keep=["doc_id", "held_out"])


# Personal data


@_query()
def op10_pii(spark, d):
    """All spans of every document; counts and digest are of the base spans."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.train(docs)).select("doc_id", "spans")
    written_as = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    # A second parameter of the function would be the place in the array, so the kind is bound outside.
    is_kind = lambda kind: lambda s: s["kind"] == F.lit(kind)
    counts = [F.size(F.filter(base, is_kind(k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(written_as(base), 256).alias("base_sha256"), written_as(F.col("spans")).alias("spans"))


# Top-k


@_query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256::DOUBLE * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"""
)
def op9_top_k(spark, d):
    """The five best inner products of every fiftieth vector with all others."""
    return topk.top_k(table(spark, d, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
