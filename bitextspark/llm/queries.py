"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bitextspark.llm import (
    chat,
    decontaminate,
    licences,
    neardup,
    pieces,
    pii,
    quality,
    simhash,
    spelling,
    substrings,
    tokenfile,
    treap,
    urls,
)
from bitextspark.scale import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


@register
def op1_sentencepiece(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    return pieces.round_trip(docs, PIECES).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@register
def op3_licences(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    templates = licences.BASE + licences.NOTICES
    frequencies = licences.document_frequencies(docs, templates)
    index = licences.build_index(frequencies, docs.count(), templates)
    return licences.summarise(licences.scan(docs, index), index, ["doc_id"])


def _licence_sql() -> str:
    def words(values: list[str]) -> str:
        return "[" + ", ".join(f"'{v}'" for v in values) + "]"

    starts, scores = [], []
    for number, t in enumerate(licences.BASE + licences.NOTICES):
        tests = " AND ".join(f"s+{at} >= 1 AND w[s+{at}:s+{at + len(k) - 1}] = {words(k)}" for at, k in t.key_spans())
        here = " AND ".join(f"contains(w, '{x}')" for _, k in t.key_spans() for x in sorted(set(k)))
        starts.append(
            f"CASE WHEN {here} THEN list_filter(range(1-{len(t.words)}, len(w)+1), lambda s: {tests}) ELSE [] END AS s{number}"
        )
        scores.append(
            f"list_max(list_transform(s{number}, lambda s: len(list_filter(range(0, {len(t.words)}), "
            f"lambda j: s+j >= 1 AND w[s+j] = {words(t.words)}[j+1])) / {len(t.words)}::DOUBLE))"
        )
    base = list(enumerate(licences.BASE))
    every = list(enumerate(licences.BASE + licences.NOTICES))
    places = "flatten([" + ", ".join(f"s{i}" for i, _ in base) + "])"

    def labels(of: list) -> str:
        cases = ", ".join(f"CASE WHEN len(s{i}) > 0 THEN '{t.label}' END" for i, t in of)
        return f"coalesce(array_to_string(list_sort(list_distinct(list_filter([{cases}], lambda x: x IS NOT NULL))), ','), '')"

    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licences.UPPER}', '{licences.LOWER}'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
      h AS (SELECT doc_id, w, {", ".join(starts)} FROM d)
    SELECT doc_id, len(w)::BIGINT AS n_words, len({places})::BIGINT AS n_base,
      (list_min({places}) - 1)::BIGINT AS first_word, (list_max({places}) - 1)::BIGINT AS last_word,
      {labels(base)} AS base_labels, {labels(every)} AS labels,
      coalesce(greatest({", ".join(scores)}), 0.0)::DOUBLE AS score FROM h"""


ORACLES["op3_licences"] = _licence_sql()

#: A conversation whose texts hold control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def _conversations(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(CONTROL_TEXT).alias("text"),
    )
    return given.unionByName(extra)


@register
def op6_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    location = scratch_path(spark, "chat")
    chat.examples(_conversations(spark, sf)).write.option("compression", "zstd").parquet(location)
    back = chat.read_back(spark.read.parquet(location))
    return back.select(
        "conv_id",
        "n_turns",
        F.sha2("turns_text", 256).alias("turns_sha256"),
        F.char_length("loss_text").cast("bigint").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


ORACLES["op6_chat_format"] = f"""
WITH c AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{CONTROL_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{CONTROL_TEXT}'),
e AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    7 + length(role) + 1 + length(regexp_replace(replace(text, '\\', '\\\\'), '(<|\\[)(/?(?:s>|INST\\]))', '\\1\\\\\\2', 'g')) AS size
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
s AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM e)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id"""

URL_RULES = [
    urls.Rule("org", "/", "allow"),
    urls.Rule("example.org", "/es/", "block"),
    urls.Rule("example.org", "/en/1", "block"),
    urls.Rule("com", "/fr/", "allow"),
    urls.Rule("com", "/de/", "block"),
]
#: Names of the block list; each is listed under the three top domains.
LISTED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED_DOMAINS = [f"{name}.example.{top}" for name in LISTED_NAMES for top in ("com", "net", "org")]


@register
def op7_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages", "page_id", "url")
    listed = spark.createDataFrame([(d,) for d in LISTED_DOMAINS], "key string")
    return urls.judge(pages, URL_RULES, listed).select("page_id", "host", "path", "rule", "verdict")


def _url_sql() -> str:
    cases = "\n".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}|{r.verdict}'"
        for r in sorted(URL_RULES, key=lambda r: (-len(r.name), r.name))
    )
    listed = " OR ".join(f"host = '{d}' OR ends_with(host, '.{d}')" for d in LISTED_DOMAINS)
    return f"""WITH p AS (SELECT page_id,
      translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
      regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    r AS (SELECT *, CASE {cases} END AS hit FROM p)
    SELECT page_id, host, path, CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 1) END AS rule,
      CASE WHEN hit IS NOT NULL THEN split_part(hit, '|', 2) WHEN {listed} THEN 'block' ELSE 'allow' END AS verdict FROM r"""


ORACLES["op7_url_filter"] = _url_sql()


@register
def op8_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "lang", "text")
    return quality.judge(docs, PIECES, quality.QualityRules(), keep_text=False).drop("lang", "latin_share")


@register
def op10_token_file(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    location = scratch_path(spark, "tokens")
    tokenfile.write(docs, location, WORD_PIECES, end_id=1)
    return tokenfile.checksums(spark, location)


@register
def op9_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    return neardup.link(docs, neardup.NearDuplicates(percent=85))


@register
def op2_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    return decontaminate.matches(docs, table(spark, sf, "benchmark", "item_id", "text"))


@register
def op4_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.passages(table(spark, sf, "documents", "doc_id", "text"))


def _joined_spans(name: str):
    return F.array_join(F.transform(name, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str):
    return F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")


@register
def op5_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    crf = pii.train(pii.labelled_table(spark))
    found = pii.find(table(spark, sf, "documents", "doc_id", "text"), crf).drop("text")
    return found.select(
        "doc_id",
        *map(_count, pii.KINDS),
        F.sha2(_joined_spans("base_spans"), 256).alias("base_sha256"),
        _joined_spans("all_spans").alias("spans"),
    )


@register
def op12_simhash(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.link(table(spark, sf, "documents", "doc_id", "text"))


@register
def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.variants(table(spark, sf, "documents", "doc_id", "text"))


@register
def op11_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents", "doc_id", "text")
    return treap.rank(docs, table(spark, sf, "benchmark", "item_id", "text"))


ORACLES["op11_ranked_search"] = """
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
size AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM len),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term, docs),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN len USING (doc_id), size GROUP BY ALL),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 50"""
