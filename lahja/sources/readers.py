"""Readers of staged files (no network) and the cache of corpora.

Every reader declares its schema or takes it from Parquet; line positions, where they matter, are explicit columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.cleaning import clean_line, strip_label, strip_wikitext
from ..functions.normalize import arabic_ratio, count_words, squeeze
from ..operators.blocks import lines_of

TEXT_COLUMNS = ("comment", "text", "tweet", "tweets", "post", "sentence", "content", "body")
PREFERRED = ("parquet", "jsonl", "json", "txt", "csv", "tsv")


def best_text_column(table: DataFrame, by_name: bool = True, rows: int | None = 200, missing_is_empty: bool = True) -> str | None:
    """The column that holds the text: by its usual name, else the string column that is longest on average over the first rows (a
    heuristic on a head, as the schema is unknown; ``rows=None``: over all). Missing values are empty strings in CSV and count as such; in
    Parquet they are no strings and don't count. Of equals the first column wins; none where every string is empty."""
    strings = [f.name for f in table.schema if f.dataType.simpleString() == "string"]
    if by_name:
        for want in TEXT_COLUMNS:
            for c in strings:
                if c.strip().lower() == want:
                    return c
    if not strings:
        return None
    value = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit("")) if missing_is_empty else F.col(f"`{c}`")
    head = (table if rows is None else table.limit(rows)).agg(*[F.avg(F.length(value(c))).alias(str(i)) for i, c in enumerate(strings)]).first()
    sized = [(head[str(i)] or 0.0, -i) for i in range(len(strings))]
    best = max(sized)
    return strings[-best[1]] if best[0] > 0 else None


def articles(pages: DataFrame) -> DataFrame:
    """(title, text) of pages (title, ns, redirect, body): main namespace, no redirects, with a body."""
    return pages.where((F.col("ns") == "0") & ~F.col("redirect") & (F.length("body") > 0)).select("title", F.col("body").alias("text"))


def read_dump(spark: SparkSession, path: str, max_pages: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """(title, text) of the articles of a MediaWiki dump (.xml or .xml.bz2).

    ``max_pages``: the first so many; ``max_bytes``: the articles from the beginning as long as their texts make up no more bytes."""
    schema = "title string, ns string, redirect struct<_title:string>, revision struct<text:struct<_VALUE:string,_bytes:string>>"
    pages = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    out = articles(pages.select("title", "ns", F.col("redirect").isNotNull().alias("redirect"), F.col("revision.text._VALUE").alias("body")))
    if max_pages is not None:
        out = out.limit(max_pages)
    return within_bytes(out, "text", max_bytes) if max_bytes is not None else out


def within_bytes(rows: DataFrame, text: str, max_bytes: int, order: list[str] | None = None) -> DataFrame:
    """The rows from the beginning (in ``order``, else as they come) as long as their texts make up no more bytes; sums over partitions, not one task."""
    from ..operators.classifier import running

    own = rows.withColumn("__size", F.octet_length(text)) if order else rows.withColumns({"__size": F.octet_length(text), "__pos": F.monotonically_increasing_id()})
    placed = running(own, order or ["__pos"], {"__before": "__size"})
    return placed.where(F.col("__before") + F.col("__size") <= max_bytes).select(*rows.columns)


def wiki_lines(articles: DataFrame, text: str = "text", min_words: int = 5, min_arabic: float = 0.6, keys: tuple[str, ...] = ("title",), max_lines: int | None = None) -> DataFrame:
    """(keys, line_no, line): prose lines without markup, long enough and Arabic enough; ``max_lines``: so many of them."""
    own = articles.select(*keys, F.posexplode(lines_of(strip_wikitext(F.col(text)))).alias("line_no", "line")).withColumn("line", squeeze(F.col("line")))
    raw = F.size(F.filter(F.split("line", " "), lambda w: w != ""))
    own = own.where((raw >= min_words) & (arabic_ratio(F.col("line")) >= min_arabic)).where(count_words(F.col("line")) >= min_words)
    return own if max_lines is None else own.limit(max_lines)


def read_text_lines(spark: SparkSession, paths: str) -> DataFrame:
    """Lines of text files; several blank-separated paths in one locator. Labels at their head go."""
    return spark.read.text(paths.split()).select(strip_label(F.col("value")).alias("line"))


def read_csv_text(spark: SparkSession, paths: str, sep: str = ",") -> DataFrame:
    """The text column of CSV files with a header; missing values are empty."""
    table = spark.read.option("multiLine", True).option("escape", '"').csv(paths.split(), header=True, sep=sep)
    best = best_text_column(table)
    if best is None:
        return spark.createDataFrame([], "line string")
    return table.select(F.coalesce(F.col(f"`{best}`"), F.lit("")).alias("line"))


def json_text(value: Column) -> Column:
    """The longest value that is a string of a JSON object (the first of equals; nested objects and arrays are none), or a JSON string itself; else null."""
    own = F.map_values(F.from_json(value, "map<string,variant>"))
    strings = F.filter(F.transform(own, lambda v: F.when(F.schema_of_variant(v) == "STRING", F.variant_get(v, "$", "string"))), lambda v: v.isNotNull())
    longest = F.aggregate(strings, F.lit(None).cast("string"), lambda a, v: F.when(a.isNull() | (F.length(v) > F.length(a)), v).otherwise(a))
    plain = F.from_json(F.concat(F.lit("["), value, F.lit("]")), "array<string>")[0]
    return F.when(F.trim(value).startswith("{"), longest).when(F.trim(value).startswith('"'), plain)


def read_json_text(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """The text of each JSON line; lines without one, and bad lines, are skipped."""
    return spark.read.text(path).select(json_text(F.col("value")).alias("line")).where("line is not null")


def read_tsv_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.element_at(F.split("value", "\t"), -1).alias("line"))


def read_staged(spark: SparkSession, folder: str, include: list[str] | None = None) -> DataFrame:
    """Text lines of a staged dataset: the preferred format present, restricted to folders in ``include``, at any depth."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    if include:
        rest = F.concat(F.lit("/"), F.element_at(F.split("path", folder.rstrip("/").rpartition("/")[2] + "/", 2), -1))
        listing = listing.where(F.exists(F.array(*[F.lit(f"/{x.strip('/')}/") for x in include]), lambda x: rest.contains(x)))
    kinds = {r["kind"]: r["paths"] for r in listing.groupBy(F.lower(F.regexp_extract("path", "\\.([^./]+)$", 1)).alias("kind")).agg(F.collect_list("path").alias("paths")).collect()}
    for kind in PREFERRED:
        if kind in kinds:
            paths = sorted(kinds[kind])
            if kind == "parquet":
                table = spark.read.parquet(*paths)
                best = best_text_column(table, by_name=False, missing_is_empty=False)
                return table.select(F.col(f"`{best}`").alias("line")) if best else spark.createDataFrame([], "line string")
            if kind in ("json", "jsonl"):
                return read_json_text(spark, paths)
            if kind == "csv":
                return read_csv_text(spark, " ".join(paths))
            return read_tsv_text(spark, paths) if kind == "tsv" else spark.read.text(paths).select(F.col("value").alias("line"))
    return spark.createDataFrame([], "line string")


def read_source(spark: SparkSession, source: dict, staged: str) -> DataFrame:
    """(line) of a source whose files lie in <staged>/<key>: a dump, a staged dataset, or text and CSV files."""
    folder = f"{staged}/{source['key']}"
    if source["kind"] == "wikipedia":
        return wiki_lines(read_dump(spark, folder, max_bytes=source["max_bytes"])).select("line")
    if source["kind"] == "url" and source["locator"].endswith(".txt"):
        return read_text_lines(spark, folder)
    return read_staged(spark, folder, source["include"] or None)


META = "key string, role string, kind string, locator string, license string, lines bigint, bytes bigint, mb double, path string"


def cached(spark: SparkSession, cache: str) -> DataFrame:
    """Metadata of what the cache holds, as ``fetch`` wrote it beside the lines."""
    return spark.read.schema(META + ", source string").json(f"{cache}/meta").drop("source")


def fetch(spark: SparkSession, lines: DataFrame, source: dict, cache: str, force: bool = False, min_words: int = 4, max_lines: int | None = None) -> dict:
    """Clean lines of one source into the cache, partitioned by source; an existing one is left alone unless forced. Returns its metadata."""
    path = f"{cache}/lines/source={source['key']}"
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs)
    if force or not there:
        own = lines.select(clean_line(F.col("line"), min_words).alias("line")).where("line is not null")
        if max_lines is not None:
            from ..operators.sampling import hash_sample

            own = hash_sample(own, max_lines, "line")
        own.withColumn("line_no", F.monotonically_increasing_id()).write.mode("overwrite").parquet(path)
    kept = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("lines"), F.coalesce(F.sum(F.octet_length("line") + 1), F.lit(0)).alias("bytes")).first()
    meta = {"key": source["key"], "role": source["role"], "kind": source["kind"], "locator": source["locator"], "license": source["license"], "lines": kept["lines"], "bytes": kept["bytes"], "mb": round(kept["bytes"] / (1 << 20), 2), "path": path}
    if force or not there:
        spark.createDataFrame([tuple(meta.values())], META).coalesce(1).write.mode("overwrite").json(f"{cache}/meta/source={source['key']}")
    return meta


def fetch_all(spark: SparkSession, read, sources: list[dict], cache: str, **options) -> DataFrame:
    """Metadata of each source; one that fails is recorded with its error and doesn't stop the others. ``read(source)`` gives its lines."""
    rows = []
    for s in sources:
        try:
            m = fetch(spark, read(s), s, cache, **options)
            rows.append((m["key"], m["lines"], m["mb"], None))
        except Exception as e:  # noqa: BLE001
            rows.append((s["key"], None, None, str(e)[:500]))
    return spark.createDataFrame(rows, "key string, lines bigint, mb double, error string")


def fetch_totals(meta: DataFrame) -> DataFrame:
    return meta.agg(F.round(F.sum("mb"), 2).alias("mb"), F.sum("lines").alias("lines"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("error").isNotNull(), F.col("key")))), " ").alias("failed"))


def load_cache(spark: SparkSession, cache: str, registry: DataFrame, role: str | None = None) -> DataFrame:
    """(source, line_no, line, role); the source is a partition column, so a role reads its folders only."""
    lines = spark.read.parquet(f"{cache}/lines")
    own = registry.select(F.col("key").alias("source"), "role")
    return lines.join(F.broadcast(own if role is None else own.where(F.col("role") == role)), "source")


KINDS = ("jsonl", "csv", "txt")


def read_documents(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """(pos, id, text) of a .jsonl, .csv or .txt file or a folder of .txt and .md files; empty texts go. A file may be a folder of its parts, as Spark writes it.

    Ids: jsonl id, else uid, else the line's index; csv id, else index; txt the index of the line; folder the file's name."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if not file_system.exists(fs):
        raise FileNotFoundError(path)
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if file_system.getFileStatus(fs).isDirectory() and not (kind in KINDS and file_system.globStatus(spark._jvm.org.apache.hadoop.fs.Path(fs, "part-*"))):
        files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.{txt,md,TXT,MD}").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("p"), "value")
        return files.select(F.col("p").alias("pos"), F.regexp_extract("p", "([^/]+)$", 1).alias("id"), F.col("value").alias("text"))
    if kind not in KINDS:
        raise ValueError(f"unknown extension {kind!r}: jsonl, csv, txt or a folder")
    if kind == "csv":
        table = spark.read.option("multiLine", True).option("escape", '"').csv(path, header=True)
        rows = _indexed(table)
        own = F.nullif(F.col("id"), F.lit("")) if "id" in table.columns else F.lit(None).cast("string")
        out = rows.select("pos", F.coalesce(own, F.col("pos").cast("string")).alias("id"), F.col(f"`{field}`").alias("text"))
    else:
        rows = _indexed(spark.read.text(path))
        if kind == "txt":
            out = rows.select("pos", F.col("pos").cast("string").alias("id"), F.col("value").alias("text")).where("trim(text) <> ''")
        else:
            part = lambda k: F.nullif(F.get_json_object("value", f"$.{k}"), F.lit(""))
            out = rows.where("trim(value) <> ''").select("pos", F.coalesce(part("id"), part("uid"), F.col("pos").cast("string")).alias("id"), part(field).alias("text"))
    return out.where("text is not null and text <> ''")


def _indexed(table: DataFrame) -> DataFrame:
    """The rows of files with their index over the files by name, counted by split and then over splits."""
    from ..storage import materialize

    split = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"))
    rows = materialize(table.select("*", split.alias("__s"), F.monotonically_increasing_id().alias("__m")), "indexed")
    # a split is read by one task, and the numbers of its rows follow each other
    sizes = rows.groupBy("__s").agg(F.count(F.lit(1)).alias("n"), F.min("__m").alias("__least"))
    first = sizes.select("__s", "__least", F.coalesce(F.sum("n").over(W.orderBy("__s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__first"))
    return rows.join(F.broadcast(first), "__s").withColumn("pos", F.col("__m") - F.col("__least") + F.col("__first")).drop("__m", "__s", "__least", "__first")


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(id, category, script, text); a repeated id or an unknown script is an error."""
    out = spark.read.schema("id string, category string, script string, text string").json(path).where("id is not null")
    twice = [r["id"] for r in out.groupBy("id").count().where("count > 1").limit(3).collect()]
    if twice:
        raise ValueError(f"repeated prompt ids: {twice}")
    odd = [r["script"] for r in out.where(~F.coalesce(F.col("script").isin("arabe", "arabizi"), F.lit(False))).select("script").limit(3).collect()]
    if odd:
        raise ValueError(f"unknown scripts: {odd}")
    return out


REPLY = "prompt_id string, model string, condition string, script string, reply string, error string"


def read_replies(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """The replies log; malformed lines fail, or with ``strict=False`` (to resume) are skipped."""
    return spark.read.schema(REPLY).option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


SFT = "contents array<struct<role:string,parts:array<struct<text:string>>>>"


def read_examples(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """(pos, split, prompt, text) of training examples in <folder>/<split>.jsonl: the first turn is the prompt, the second the text. A missing file is an error."""
    out = None
    for k, split in enumerate(splits):
        rows = _indexed(spark.read.schema(SFT).option("mode", "FAILFAST").json(f"{folder}/{split}.jsonl"))
        own = rows.select((F.col("pos") * len(splits) + k).alias("n"), F.struct(F.lit(k).alias("split"), "pos").alias("pos"), F.lit(split).alias("split"), F.col("contents")[0]["parts"][0]["text"].alias("prompt"), F.col("contents")[1]["parts"][0]["text"].alias("text")).drop("n")
        out = own if out is None else out.union(own)
    return out


def read_fingerprints(spark: SparkSession, folder: str, splits: tuple[str, ...] = ("train", "validation")) -> DataFrame:
    """(pos, fingerprint, uid) of the references in <folder>/<split>.jsonl; files that are missing are passed over."""
    out = spark.createDataFrame([], "pos struct<split:int,pos:bigint>, fingerprint string, uid string")
    for k, split in enumerate(splits):
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{split}.jsonl")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            rows = _indexed(spark.read.schema("references struct<source_fingerprint:string,source_uid:string>").json(path.toString()))
            out = out.union(rows.select(F.struct(F.lit(k).alias("split"), "pos").alias("pos"), "references.source_fingerprint", "references.source_uid"))
    return out.where("fingerprint <> '' and uid <> ''")


def read_markdown_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, meta, title, text) of the .md files of a tree: a head of "key: value" lines between lines of ---, the first # heading, the rest."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", "\\r\\n?", "\n").alias("value"))
    head = F.regexp_extract("value", "(?s)^---\n(.*?)\n---[ \t]*(?:\n|$)", 1)
    pairs = F.filter(F.split(head, "\n"), lambda x: x.rlike("^[^:#]+:"))
    meta = F.map_from_entries(F.array_distinct(F.transform(pairs, lambda x: F.struct(F.lower(F.trim(F.substring_index(x, ":", 1))).alias("key"), F.trim(F.regexp_replace(x, "^[^:]+:\\s*[\"']?|[\"']?\\s*$", "")).alias("value")))))
    body = F.regexp_replace("value", "(?s)^---\n.*?\n---[ \t]*(?:\n|$)", "")
    title = F.nullif(F.trim(F.regexp_extract(body, "(?m)^#[ \t]+(.+)$", 1)), F.lit(""))
    return files.select("path", meta.alias("meta"), title.alias("title"), F.trim(F.regexp_replace(body, "(?m)^#.*$", "")).alias("text"))


def read_env(path: str, environment: dict[str, str]) -> list[str]:
    """Set KEY=VALUE lines of a file in an environment, where it lacks them; the keys that were set."""
    found = []
    with open(path, encoding="utf-8") as f:
        for line in f:
            key, eq, value = line.strip().removeprefix("export ").partition("=")
            key = key.strip()
            if eq and key and not key.startswith("#") and not environment.get(key):
                environment[key] = value.strip().strip("\"'")
                found.append(key)
    return found


def generated_volume(replies: DataFrame, text: str, goal: int = 1800, target: int = 60) -> DataFrame:
    """One row (replies, words, blocks, enough): whether generated replies make up so many blocks."""
    words = F.size(F.filter(F.split(squeeze(F.col(text)), " "), lambda w: w != ""))
    own = replies.agg(F.count(F.lit(1)).alias("replies"), F.coalesce(F.sum(words), F.lit(0)).alias("words"))
    blocks = F.floor(F.col("words") / target)
    return own.select("replies", "words", blocks.alias("blocks"), (blocks >= goal).alias("enough"))
