"""Queries on what goes in and out: imports, exports, shared files, packing of context and of extraction units, digests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyrook.functions import ids, markdown, text
from tallyrook.jobs.catalog import query
from tallyrook.jobs.records import _COLLAPSE
from tallyrook.operators import candidates, store
from tallyrook.sources import graph as held
from tallyrook.sources import discovery, tables
from tallyrook.sources.graph import GRAPH_SQL, entities, relations
from tallyrook.sources.tables import RECORDS_SQL, table

c = F.col
_ID = "'mem_' || substr(sha256(concat_ws(chr(0), kind, scope, coalesce(scope_key, ''), content)), 1, 32)"


@query(
    f"""WITH {RECORDS_SQL}, given AS (SELECT *, CASE WHEN doc_id % 13 = 0 THEN 'mem_wrong' ELSE {_ID} END AS given_id, doc_id + 1 AS ref FROM mem)
SELECT doc_id, CASE WHEN given_id <> {_ID} THEN 'id_mismatch' WHEN doc_id % 4 = 0 AND ref NOT IN (SELECT doc_id FROM mem) THEN 'missing_relation' WHEN doc_id % 29 = 0 THEN 'tombstoned' ELSE 'imported' END AS verdict FROM given"""
)
def snapshot_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an import does with each row: ids are derived again, relations must exist, tombstones block."""
    rows = tables.records(spark, sf_dir)
    own = ids.memory_id(c("kind"), c("scope"), c("scope_key"), c("content"))
    given = rows.select("doc_id", own.alias("own"), F.when(c("doc_id") % 13 == 0, "mem_wrong").otherwise(own).alias("given"), (c("doc_id") + 1).alias("ref"))
    met = given.join(rows.select(c("doc_id").alias("ref"), F.lit(True).alias("there")), "ref", "left")
    verdict = F.when(c("given") != c("own"), "id_mismatch").when((c("doc_id") % 4 == 0) & c("there").isNull(), "missing_relation").when(c("doc_id") % 29 == 0, "tombstoned").otherwise("imported")
    return met.select("doc_id", verdict.alias("verdict"))


@query(
    f"""WITH {GRAPH_SQL}, rows_ AS (SELECT 1 AS section, entity AS id FROM ent UNION ALL SELECT 2, CAST(relation AS VARCHAR) FROM rel UNION ALL SELECT 3, CAST(fact AS VARCHAR) FROM fct UNION ALL SELECT DISTINCT 4, CAST(observation AS VARCHAR) FROM obs)
SELECT section, id, n, n // 100 AS page FROM (SELECT *, row_number() OVER (ORDER BY section, id) - 1 AS n FROM rows_)"""
)
def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages of an export: entities, relations, facts, observations, each by id; a cursor is a row's number."""
    of = lambda n, rows, key: rows.select(F.lit(n).alias("section"), c(key).cast("string").alias("id"))
    rows = store.union(of(1, entities(spark, sf_dir), "entity"), of(2, relations(spark, sf_dir), "relation"), of(3, held.facts(spark, sf_dir), "fact"), of(4, held.observations(spark, sf_dir), "observation").distinct())
    return store.numbered(rows, "section", "id").select("section", "id", "n", F.expr("n div 100").alias("page"))


@query(
    f"""WITH {GRAPH_SQL}, named AS (SELECT entity, name FROM ent UNION SELECT entity, type || ' ' || substr(entity, 2) FROM ent), mention AS (SELECT DISTINCT CASE WHEN l_partkey % 3 = 0 THEN 'supplier ' || l_suppkey WHEN l_partkey % 3 = 1 THEN 'nation ' || (l_suppkey % 40) ELSE 'customer 000000' || l_suppkey END AS mention FROM lineitem)
SELECT mention, CASE WHEN count(DISTINCT entity) = 1 THEN min(entity) END AS entity, count(DISTINCT entity) AS matches FROM mention LEFT JOIN named ON name = mention GROUP BY mention"""
)
def mention_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mentions and the entity whose name or alias they are, if it is the only one."""
    e = entities(spark, sf_dir)
    named = e.select("entity", F.explode(F.array_distinct(F.array(c("name"), F.concat(c("type"), F.lit(" "), F.substring("entity", 2, 100))))).alias("mention"))
    by, key = c("l_partkey") % 3, c("l_suppkey")
    said = F.when(by == 0, F.concat(F.lit("supplier "), key)).when(by == 1, F.concat(F.lit("nation "), key % 40)).otherwise(F.concat(F.lit("customer 000000"), key))
    mentions = table(spark, sf_dir, "lineitem").select(said.alias("mention")).distinct()
    found = mentions.join(named, "mention", "left").groupBy("mention").agg(F.count("entity").alias("matches"), F.min("entity").alias("first"))
    return found.select("mention", F.when(c("matches") == 1, c("first")).alias("entity"), "matches")


@query(
    """WITH s AS (SELECT conv_id, turn, length(coalesce(text, '')) + 320 AS size, sum(length(coalesce(text, '')) + 320) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS total FROM conversations)
SELECT conv_id, count(*) AS packed, CAST(max(total) AS BIGINT) AS chars FROM s WHERE total <= 2000 GROUP BY conv_id"""
)
def context_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns of a conversation fit the budget before the first that does not."""
    so_far = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    sized = table(spark, sf_dir, "conversations").withColumn("total", F.sum(F.length(F.coalesce("text", F.lit(""))) + 320).over(so_far))
    return sized.filter("total <= 2000").groupBy("conv_id").agg(F.count("*").alias("packed"), F.max("total").cast("long").alias("chars"))


@query(
    f"""WITH t AS (SELECT conv_id, turn, role, {_COLLAPSE.format("coalesce(text, '')")} AS text FROM conversations), quote AS (SELECT conv_id, turn, substr(text, 1, 40) AS quote FROM t WHERE role = 'assistant' AND length(text) >= 3 UNION ALL SELECT conv_id, turn + 1, substr(text, 5, 30) FROM t WHERE role = 'user' AND length(text) >= 8)
SELECT q.conv_id, q.turn, q.quote, count(t.turn) > 0 AS supported FROM quote q LEFT JOIN t ON t.conv_id = q.conv_id AND t.role = 'user' AND contains(t.text, q.quote) GROUP BY ALL"""
)
def evidence_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a quote stands in what the user said in its conversation."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.collapse(F.coalesce("text", F.lit(""))).alias("text"))
    own = t.filter("role = 'assistant' AND length(text) >= 3").select("conv_id", "turn", F.substring("text", 1, 40).alias("quote"))
    theirs = t.filter("role = 'user' AND length(text) >= 8").select("conv_id", (c("turn") + 1).alias("turn"), F.substring("text", 5, 30).alias("quote"))
    quotes = store.cut(own.unionByName(theirs).distinct())
    proven = candidates.quoted(quotes, t.filter("role = 'user'"), "conv_id", ("turn",)).withColumn("proven", F.lit(True))
    return quotes.join(proven, ["conv_id", "quote"], "left").select("conv_id", "turn", "quote", c("proven").isNotNull().alias("supported"))


_PAYLOADS = ("sound", "unknown_key", "proven", "unproven", "repeated_key", "not_json", "many", "no_anchor", "importance", "unclosed", "silent")


@query(
    f"""WITH m AS (SELECT conv_id, turn, (conv_id * 7 + turn) % {len(_PAYLOADS)} AS k, {_COLLAPSE.format("min(coalesce(text, ''))")} AS said FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
), u AS (SELECT conv_id, turn, {_COLLAPSE.format("coalesce(text, '')")} AS text FROM conversations WHERE role = 'user'
), b AS (SELECT m.conv_id, m.turn, k, said, coalesce(min(text), '') AS before FROM m LEFT JOIN u ON u.conv_id = m.conv_id AND u.turn = m.turn - 1 GROUP BY ALL
), q AS (SELECT *, trim(CASE k WHEN 2 THEN substr(before, 3, 40) ELSE 'never ' || substr(said, 1, 30) END) AS quote FROM b
), r AS (SELECT q.conv_id, q.turn, k, said, length(quote) >= 3 AND coalesce(bool_or(contains(text, quote)), false) AS ok FROM q LEFT JOIN u USING (conv_id) GROUP BY q.conv_id, q.turn, k, said, quote
), c AS (SELECT *, CASE k {" ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(_PAYLOADS))} END AS made FROM r)
SELECT conv_id, turn, CASE WHEN made NOT IN ('not_json', 'unclosed') THEN CAST(n AS INT) END AS n, CASE WHEN made IN ('proven', 'unproven') THEN CASE WHEN NOT ok THEN 'evidence' END WHEN made = 'many' THEN CASE WHEN n > 2 THEN 'beyond' END WHEN made <> 'sound' THEN made END AS code,
  CASE WHEN made = 'sound' OR (made = 'many' AND n < 3) OR (made IN ('proven', 'unproven') AND ok) THEN 'n' || n || ' ' || substr(said, 1, 20) END AS title
FROM c, range(5) t(n) WHERE made <> 'silent' AND (n = 0 OR made = 'many')"""
)
def curated_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads in what assistants say, made from each message and the one before it: their candidates, accepted or refused with a code."""
    t = table(spark, sf_dir, "conversations")
    said = t.filter("role = 'assistant'").groupBy("conv_id", "turn").agg(text.collapse(F.min(F.coalesce("text", F.lit("")))).alias("said"))
    users = t.filter("role = 'user'").select("conv_id", "turn", text.collapse(F.coalesce("text", F.lit(""))).alias("text"))
    before = users.groupBy("conv_id", (c("turn") + 1).alias("turn")).agg(F.min("text").alias("before"))
    m = said.join(before, ["conv_id", "turn"], "left").withColumns({"before": F.coalesce("before", F.lit("")), "k": (c("conv_id") * 7 + c("turn")) % len(_PAYLOADS)})
    is_ = {x: c("k") == i for i, x in enumerate(_PAYLOADS)}
    of_user = is_["proven"] | is_["unproven"]

    def one(n: Column) -> Column:
        title = F.concat(F.lit("n"), n.cast("string"), F.lit(" "), F.substring("said", 1, 20))
        quote = F.when(is_["proven"], F.substring("before", 3, 40)).when(is_["unproven"], F.concat(F.lit("never "), F.substring("said", 1, 30)))
        fields = {"title": title, "content": F.concat(F.lit("about "), F.substring("said", 1, 200)), "kind": F.when(of_user, "preference").when(is_["no_anchor"], "fact").otherwise("pattern"), "taxonomy": F.when(of_user, "user_preference"),
                  "importance": F.when(is_["importance"], 0.9).otherwise(0.5), "tags": F.array(F.lit("one"), F.lit("two")), "code_paths": F.array().cast("array<string>"), "evidence_quote": quote, "secret": F.when(is_["unknown_key"], 1)}
        json = F.to_json(F.struct(*(x.alias(k) for k, x in fields.items())))
        return F.when(is_["repeated_key"], F.replace(json, F.lit('"tags"'), F.lit('"kind":"gotcha","tags"'))).otherwise(json)

    each = F.transform(F.sequence(F.lit(0), F.when(is_["many"], 4).otherwise(0)), one)
    payload = F.concat(F.lit("["), F.array_join(each, ","), F.when(is_["not_json"], "] and more").otherwise("]"))
    close = F.when(is_["unclosed"], "").otherwise(candidates.CLOSE)
    whole = F.when(is_["silent"], c("said")).otherwise(F.concat("said", F.lit(candidates.OPEN + "\n"), payload, F.lit("\n"), close))
    keys = ["conv_id", "turn"]
    found = store.cut(candidates.parsed(m.select(*keys, whole.alias("text")), keys))
    return candidates.judged(found, users, keys, "conv_id", ("turn",)).select(*keys, "n", "code", F.when(c("accepted"), c("title")).alias("title"))


#: UTF-8 bytes of a unit and of all units of a conversation.
UNIT_BYTES, CONVERSATION_BYTES = 32 * 1024, 256 * 1024


def _fitted(rows: Iterable[tuple], each: int, total: int) -> Iterator[tuple]:
    """conv_id, turn, bytes and rejected of rows (conv_id, turn, text), each conversation's together and in order."""
    for _, own in groupby(rows, key=lambda row: row[0]):
        left = total
        for conv, turn, unit in own:
            kept = (unit or "").encode()[:each].decode(errors="ignore")
            size = len(kept.encode())
            code = "empty" if not kept.strip() else "budget" if size > left else None
            left -= 0 if code else size
            yield conv, turn, 0 if code else size, code


def fit_units(rows: pd.DataFrame, each: int = 1000, total: int = 2500) -> pd.DataFrame:
    """Units in order: cut to `each` UTF-8 bytes at a character's end; one that no longer fits `total` is rejected, later ones may fit."""
    rows = rows.sort_values(["turn", "role", "text"], kind="stable", na_position="first")
    return pd.DataFrame(_fitted(zip(rows["conv_id"], rows["turn"], rows["text"], strict=True), each, total), columns=["conv_id", "turn", "bytes", "rejected"])


@query(
    f"""WITH RECURSIVE t AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, octet_length(encode(coalesce(text, ''))) AS size, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) = '' AS empty FROM conversations
), fold(conv_id, turn, n, bytes, rejected, spent) AS (
  SELECT DISTINCT conv_id, NULL::BIGINT, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, 0::BIGINT FROM t
  UNION ALL SELECT t.conv_id, t.turn, t.n, CASE WHEN empty OR spent + size > {256 * 1024} THEN 0 ELSE size END, CASE WHEN empty THEN 'empty' WHEN spent + size > {256 * 1024} THEN 'budget' END, spent + CASE WHEN empty OR spent + size > {256 * 1024} THEN 0 ELSE size END
  FROM fold JOIN t ON t.conv_id = fold.conv_id AND t.n = fold.n + 1)
SELECT conv_id, turn, bytes, rejected FROM fold WHERE n > 0"""
)
def extraction_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of each conversation that an extraction may read, within a budget of bytes. Conversations stream turn by turn."""
    t = table(spark, sf_dir, "conversations").select(c("conv_id").cast("long"), c("turn").cast("long"), "role", F.substring("text", 1, UNIT_BYTES).alias("text"))
    ordered = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "turn", "text")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = _fitted((row for batch in batches for row in zip(*(x.to_pylist() for x in batch.columns), strict=True)), UNIT_BYTES, CONVERSATION_BYTES)
        while some := list(islice(units, 2000)):
            columns = (pa.array(x, kind) for x, kind in zip(zip(*some, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))
            yield pa.RecordBatch.from_arrays(list(columns), ["conv_id", "turn", "bytes", "rejected"])

    return ordered.mapInArrow(fit, "conv_id long, turn long, bytes long, rejected string")


_LEVEL = lambda source, digits: f"SELECT scope, substr(slot, 1, {digits}) AS slot, sha256(string_agg(h, '' ORDER BY h)) AS h FROM {source} GROUP BY 1, 2"


@query(
    f"""WITH {RECORDS_SQL}, r AS (SELECT scope, sha256(concat_ws('|', doc_id, kind, scope, updated_ms, expires_ms, pinned::INT, locked::INT)) AS h FROM mem), s AS (SELECT scope, substr(h, 1, 2) AS slot, h FROM r), l2 AS ({_LEVEL("s", 2)}), l1 AS ({_LEVEL("l2", 1)})
SELECT scope, sha256(string_agg(h, '' ORDER BY h)) AS digest FROM l1 GROUP BY scope"""
)
def metadata_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of the metadata of each scope, without feedback, level by level, so that no list of rows grows with the table."""
    parts = ["doc_id", "kind", "scope", "updated_ms", "expires_ms"]
    row = F.sha2(F.concat_ws("|", *(c(p).cast("string") for p in parts), c("pinned").cast("int").cast("string"), c("locked").cast("int").cast("string")), 256)
    return store.tree_digest(tables.records(spark, sf_dir).select("scope", row.alias("h")), "scope", "h")


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank percentiles."""
    return store.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95})


@query(
    r"""WITH f AS (SELECT doc_id, '---' || chr(10) || 'title: ' || coalesce(source, '') || ' ' || doc_id || chr(10) || CASE WHEN doc_id % 6 <> 0 THEN 'kind: fact' || chr(10) ELSE '' END || 'tags: ' || coalesce(lang, '') || ', ' || coalesce(source, '') || chr(10) || CASE WHEN doc_id % 10 <> 0 THEN '---' || chr(10) ELSE '' END || coalesce(text, '') AS file FROM documents)
, p AS (SELECT doc_id, regexp_extract(file, '^---\n((?:[^\n]*\n)*?)---\n', 1) AS head, regexp_matches(file, '^---\n(?:[a-z]+:[^\n]*\n)*---\n') AS ok, regexp_replace(file, '^---\n(?:[a-z]+:[^\n]*\n)*---\n', '') AS body FROM f)
SELECT doc_id, CASE WHEN NOT ok THEN 'no_frontmatter' WHEN regexp_extract(head, '(?m)^kind: (.*)$', 1) = '' THEN 'kind_missing' ELSE 'ok' END AS verdict, CASE WHEN ok THEN regexp_extract(head, '(?m)^title: (.*)$', 1) END AS title, CASE WHEN ok THEN len(string_split(regexp_extract(head, '(?m)^tags: (.*)$', 1), ', ')) END AS tags, CASE WHEN ok THEN sha256(body) END AS body_sha256 FROM p"""
)
def shared_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared files as they are written, front matter and body, read again; what is malformed is named."""
    d = table(spark, sf_dir, "documents")
    none, i, nl = F.lit(""), c("doc_id"), F.lit("\n")
    source, lang = F.coalesce("source", none), F.coalesce("lang", none)
    head = F.concat(F.lit("---\ntitle: "), source, F.lit(" "), i.cast("string"), nl, F.when(i % 6 != 0, "kind: fact\n").otherwise(""), F.lit("tags: "), lang, F.lit(", "), source, nl, F.when(i % 10 != 0, "---\n").otherwise(""))
    file = d.select("doc_id", F.concat(head, F.coalesce("text", none)).alias("file"))
    whole = r"^---\n((?:[a-z]+:[^\n]*\n)*)---\n"
    parsed = file.select("doc_id", c("file").rlike(whole).alias("ok"), F.regexp_extract("file", whole, 1).alias("head"), F.regexp_replace("file", whole, "").alias("body"))
    field = lambda name: F.regexp_extract("head", rf"(?m)^{name}: (.*)$", 1)
    verdict = F.when(~c("ok"), "no_frontmatter").when(field("kind") == "", "kind_missing").otherwise("ok")
    return parsed.select("doc_id", verdict.alias("verdict"), F.when(c("ok"), field("title")).alias("title"), F.when(c("ok"), F.size(F.split(field("tags"), ", ")).cast("long")).alias("tags"), F.when(c("ok"), F.sha2("body", 256)).alias("body_sha256"))


@query(
    """WITH t AS (SELECT doc_id, list_filter([trim(lang), upper(lang), ' ' || source, source, lang || '-x'], lambda x: x IS NOT NULL AND trim(x) <> '') AS tags FROM documents), u AS (SELECT doc_id, list_transform(tags, lambda x: trim(x)) AS tags FROM t)
SELECT doc_id, array_to_string(list_filter(tags, lambda x, i: list_position(list_transform(tags, lambda y: lower(y)), lower(x)) = i), ',') AS tags FROM u"""
)
def tag_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tags without repeats, whatever their case, in the spelling that came first."""
    lang, source = c("lang"), c("source")
    raw = F.array(F.trim(lang), F.upper(lang), F.concat(F.lit(" "), source), source, F.concat(lang, F.lit("-x")))
    tags = F.transform(F.filter(raw, lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: F.trim(x))
    rows = table(spark, sf_dir, "documents").select("doc_id", tags.alias("tags")).withColumn("lower", F.transform("tags", lambda x: F.lower(x)))
    first = F.filter("tags", lambda x, i: F.array_position(c("lower"), F.lower(x)) == i + 1)
    return rows.select("doc_id", F.array_join(first, ",").alias("tags"))


_LE = lambda x: f"from_hex(array_to_string(list_reverse(regexp_extract_all(printf('%016x', octet_length({x})), '..')), ''))"
_CONTROL = "[\\x00-\\x1f\\x7f]"


@query(
    f"""WITH {RECORDS_SQL}, t AS (SELECT doc_id, title, content, kind, {_COLLAPSE.format("content")} AS flat, trim(regexp_replace(title || chr(9) || substr(content, 1, 600), '{_CONTROL}', ' ', 'g')) AS meta FROM mem)
SELECT doc_id, sha256(flat) AS evidence_sha256, CASE WHEN length(meta) > 512 THEN substr(meta, 1, 496) || chr(10) || '...[truncated]' ELSE meta END AS metadata, replace(replace(CAST(to_json({{'title': title}}) AS VARCHAR), '<', '\\u003c'), '>', '\\u003e') AS json,
  sha256(unhex(hex({_LE("encode(kind)")}) || hex(encode(kind)) || hex({_LE("encode(title)")}) || hex(encode(title)))) AS fingerprint, sha256(replace('passage: {{text}}', '{{text}}', content)) AS passage_sha256, lower({_COLLAPSE.format("title")}) AS name FROM t"""
)
def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence and metadata made plain, JSON that opens no tag, fingerprints of fields with their lengths, templates, normal names."""
    rows = tables.records(spark, sf_dir)
    meta = F.concat("title", F.lit("\t"), F.substring("content", 1, 600))
    return rows.select(
        "doc_id",
        F.sha2(text.collapse(c("content")), 256).alias("evidence_sha256"),
        text.metadata(meta).alias("metadata"),
        text.safe_json(F.to_json(F.struct("title"))).alias("json"),
        ids.fields_fingerprint(c("kind"), c("title")).alias("fingerprint"),
        F.sha2(text.filled("passage: {text}", text=c("content")), 256).alias("passage_sha256"),
        text.normal_name(c("title")).alias("name"),
    )


@query(
    r"""WITH b AS (SELECT page_id, regexp_replace(coalesce(html, ''), '(?s)<title>.*?</title>|<style>.*?</style>|<script>.*?</script>|<!--.*?-->', '', 'g') AS html FROM pages)
, x AS (SELECT page_id, regexp_extract_all(html, '(?s)<h1>(.*?)</h1>', 1) AS h, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2) AS said, regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1) AS target, len(regexp_extract_all(html, '<li>')) AS items, regexp_replace(regexp_replace(html, '<[^>]*>|&(amp|lt|gt|quot|copy|middot);?', '', 'g'), '\P{L}', '', 'g') AS letters FROM b)
SELECT page_id, array_to_string(list_transform(h, lambda x: '# ' || trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), chr(10)) AS headings, len(said) AS links, sha256(array_to_string(list_transform(range(1, len(said) + 1), lambda i: regexp_replace(regexp_replace(regexp_replace(regexp_replace(said[i], '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g') || ' ' || target[i]), chr(10))) AS links_sha256, items, sha256(letters) AS letters_sha256,
  CASE WHEN letters = '' THEN 'empty' END AS reject FROM x"""
)
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown, and what of their structure reads back from it: headings, links, items, and all letters."""
    pages = table(spark, sf_dir, "pages").select("page_id", markdown.html_markdown(c("html")).alias("text"))
    told = pages.withColumn("o", markdown.outline(c("text")))
    letters = F.regexp_replace(F.regexp_replace("text", r"\]\([^)\s]*\)", ""), r"\P{L}", "")
    links = F.transform("o.links", lambda x: F.concat_ws(" ", x["text"], x["target"]))
    return told.select(
        "page_id", F.array_join("o.headings", "\n").alias("headings"), F.size("o.links").cast("long").alias("links"), F.sha2(F.array_join(links, "\n"), 256).alias("links_sha256"), "o.items",
        F.sha2(letters, 256).alias("letters_sha256"), markdown.extraction_reject(c("text")).alias("reject"),
    )


_TREE = {
    ".gitignore": "*.html\n# note\nb1?/\n!b13/\ns4/**/b2\n",
    "s1/.gitignore": "!*.html\n/l1/\n",
    "s2/.ignore": "*.html\n!.draft*\n",
    "s2/l0/.gitignore": "!*.html\n",
    "s0/l2/.gitignore": "*[05].md\n!*10.md\n",
}


@query(
    f"""WITH f AS (SELECT doc_id AS i, doc_id % 5 AS s, doc_id // 5 % 3 AS l, doc_id // 7 % 20 AS b, doc_id % 11 = 0 AS draft, ['md', 'html', 'txt', 'PDF'][1 + doc_id % 4] AS suffix FROM documents
), p AS (SELECT *, CASE WHEN i % 97 = 0 THEN '../' ELSE '' END || 's' || s || '/l' || l || '/b' || b || '/' || CASE WHEN draft THEN '.draft' ELSE 'd' END || i || '.' || suffix AS path FROM f
), v AS (SELECT path, CASE WHEN i % 97 = 0 THEN 'unsafe_path' WHEN (s = 3 AND l = 2) OR (b >= 10 AND b <> 13) OR (s = 4 AND b = 2) OR (s = 1 AND l = 1) THEN 'pruned'
    WHEN s = 0 AND l = 2 AND suffix = 'md' AND (i % 5 = 0) AND NOT i % 100 = 10 THEN 'ignored' WHEN suffix = 'html' AND NOT (s = 1 OR (s = 2 AND draft)) THEN 'ignored'
    WHEN draft AND NOT (s = 2 OR (s = 1 AND suffix = 'html') OR (s = 0 AND l = 2 AND suffix = 'md' AND i % 100 = 10)) THEN 'hidden' WHEN suffix = 'txt' THEN 'unsupported' ELSE 'found' END AS verdict FROM p
  UNION ALL SELECT * FROM (VALUES {", ".join(f"('{x}', 'hidden')" for x in _TREE)}, ('s3/l2', 'link')))
SELECT path, verdict, CASE WHEN verdict = 'found' THEN row_number() OVER (PARTITION BY verdict ORDER BY path) - 1 END AS n, (SELECT count(*) FROM v WHERE verdict = 'found') > 1000 AS refused FROM v"""
)
def document_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree with ignore files at several levels: which of them an index takes, in what order, and whether they are too many."""
    i = c("doc_id")
    suffix = F.get(F.array(*map(F.lit, ("md", "html", "txt", "PDF"))), (i % 4).cast("int"))
    folder = F.format_string("s%d/l%d/b%d/", i % 5, F.expr("doc_id div 5") % 3, F.expr("doc_id div 7") % 20)
    path = F.concat(F.when(i % 97 == 0, "../").otherwise(""), folder, F.when(i % 11 == 0, ".draft").otherwise("d"), i.cast("string"), F.lit("."), suffix)
    files = table(spark, sf_dir, "documents").select(path.alias("path"), F.lit("file").alias("kind"), F.lit(None).cast("string").alias("text"))
    rules = spark.createDataFrame([*((at, "file", said) for at, said in _TREE.items()), ("s3/l2", "link", None)], files.schema)
    return discovery.limited(discovery.discovered(files.unionByName(rules)))
