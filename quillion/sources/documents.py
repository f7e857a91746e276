"""Document sources: JSON Lines, text queries, dumps of wiki pages, folders of files, query samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.tokenizer import STOPWORDS
from .tables import dense_ids

DOCUMENT = T.StructType([T.StructField(x, T.StringType()) for x in ("id", "title", "body")])


def require_fields(docs: DataFrame) -> DataFrame:
    """``docs`` whose evaluation fails where a field is missing."""
    bad = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.lit(f"a document has no {c}"))).otherwise(F.col(c)).alias(c)
    return docs.select(*[bad(c) if c in DOCUMENT.names else F.col(c) for c in docs.columns])


def read_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """(id, title, body) of a file or folder of JSON Lines.

    Blank lines are skipped and other fields ignored; broken JSON or a missing
    field fails the whole read.  Numbers given as a field are read as strings.
    """
    return require_fields(spark.read.schema(DOCUMENT).option("mode", "FAILFAST").json(path))


def parse_jsonl(spark: SparkSession, lines: list[str]) -> DataFrame:
    """As ``read_jsonl``, from lines that the driver has (standard input)."""
    held = spark.createDataFrame([(x,) for x in lines if x.strip()], "value string")
    parsed = held.select(F.from_json("value", DOCUMENT, {"mode": "FAILFAST"}).alias("d")).select("d.*")
    return require_fields(parsed)


def stream_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the documents in files that arrive in a folder; as in ``read_jsonl`` a broken or incomplete line is an error."""
    return require_fields(spark.readStream.schema(DOCUMENT).option("mode", "FAILFAST").json(path))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query): trimmed lines that are not blank, from 0 in the file's order; a file without one is an error."""
    lines = spark.read.text(path).select(F.trim("value").alias("query"))
    found = dense_ids(lines.where("query <> ''"), [], "query_id").select("query_id", "query")
    if not found.head(1):
        raise ValueError(f"{path} has no query")
    return found


def wiki_dump(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """(id, title, body) of a dump with a line of action and a line of page in turn; gzip is read as well.

    Broken lines and pages without title or text are skipped.  A page takes the id
    of the last action line before it if no page came between, else ``doc-`` and
    the number of pages before it.  Lines of one file are in order; a page's
    action line lies in the same split or the one before.
    """
    wanted = "index struct<_id: string>, title string, text string"
    lines = spark.read.text(path).select("value", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("line"))
    parsed = lines.withColumn("d", F.from_json("value", wanted, {"mode": "PERMISSIVE"})).where(F.col("d").isNotNull())
    kind = F.when(F.col("d.index").isNotNull() & F.col("d.title").isNull(), "action").otherwise("page")
    parsed = parsed.withColumn("kind", kind).where("kind = 'action' OR get_json_object(value, '$') IS NOT NULL")
    by_file = Window.partitionBy("file").orderBy("line")
    got = parsed.withColumn("before", F.lag(F.struct("kind", F.col("d.index._id").alias("id"))).over(by_file))
    pages = got.where("kind = 'page' AND coalesce(d.title, '') <> '' AND coalesce(d.text, '') <> ''")
    numbered = dense_ids(pages.select("file", "line", "d", "before"), ["file", "line"], "n")
    own = F.when(F.col("before.kind") == "action", F.col("before.id"))
    out = numbered.select(F.coalesce(own, F.concat(F.lit("doc-"), "n")).alias("id"), F.col("d.title").alias("title"), F.col("d.text").alias("body"), "n")
    return (out.where(F.col("n") < limit) if limit is not None else out).drop("n")


TEXT_EXTENSIONS = tuple(
    "txt md rst tex log csv json xml yaml yml toml ini cfg conf html css vue svelte js jsx mjs ts tsx py rs go c h cc cpp hpp m java kt scala swift php pl r lua sh zsh sql".split()
)
SKIPPED_FOLDERS = tuple(
    "node_modules bower_components site-packages __pycache__ venv .venv target dist Library Applications Movies Music Pictures Public "
    ".git .hg .svn .gradle .cache .cargo .rustup .npm .nvm .conda .pyenv .gem .cpan .ivy2 .m2 .docker .vscode .Trash".split()
)


def read_folder(spark: SparkSession, root: str, max_bytes: int | None = None, max_chars: int | None = None, limit: int | None = None) -> DataFrame:
    """(id, title, body) of the text files under a folder: path, path within the folder, text.

    Files of other kinds, in folders of tools, that are no UTF-8 or blank are left
    out.  Nothing is cut unless asked for: files over ``max_bytes`` are left out
    then, texts cut to ``max_chars``, and ``limit`` documents in order of path taken.
    """
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace("path", "^file:/*", "/")
    inner = F.substring(path, F.lit(len(base) + 2), F.length(path))
    parts = F.split(inner, "/")
    kind = F.lower(F.regexp_extract(F.element_at(parts, -1), r".\.([^.]+)$", 1))
    text = F.try_validate_utf8(F.col("content").cast("string"))
    found = files.where((F.col("length") <= max_bytes if max_bytes is not None else F.lit(True)) & kind.isin(*TEXT_EXTENSIONS) & ~F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*map(F.lit, SKIPPED_FOLDERS))))
    docs = found.select(path.alias("id"), inner.alias("title"), (F.substring(text, 1, max_chars) if max_chars is not None else text).alias("body")).where(F.col("body").isNotNull() & F.col("body").rlike(r"\S"))
    return docs.orderBy("id").limit(limit) if limit is not None else docs


def sample_queries(docs: DataFrame, id: str = "doc_id", title: str = "title", every: int = 1499, limit: int | None = 500) -> DataFrame:
    """(<id>, query): queries from the titles of every ``every``-th document.

    In turn up to four words, two words, the longest word; titles of one word give
    that word.  Only words of letters and digits that are no stopwords count.
    """
    words = F.filter(F.split(F.lower(F.trim(title)), r"\s+"), lambda w: w.rlike(r"^[\p{L}\p{N}]+$") & ~w.isin(*STOPWORDS))
    held = docs.where(F.pmod(F.col(id), F.lit(every)) == 0).select(id, words.alias("w")).where(F.size("w") > 0)
    numbered = dense_ids(held, [id], "n")
    longest = F.array_max(F.transform("w", lambda w, i: F.struct(F.length(w).alias("n"), (-i).alias("i"), w.alias("w"))))["w"]
    turn, several = F.pmod("n", F.lit(3)), F.size("w") >= 2
    query = F.when((turn == 0) & several, F.array_join(F.slice("w", 1, 4), " ")).when((turn == 1) & several, F.array_join(F.slice("w", 1, 2), " ")).otherwise(longest)
    out = numbered.select(id, query.alias("query"), "n")
    return (out.where(F.col("n") < limit) if limit is not None else out).drop("n")


def from_text_table(table: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, id, title, body) of a table with one text column: the first line is the title, the rest the body."""
    body = F.when(F.instr(text, "\n") > 0, F.expr(f"substr({text}, instr({text}, '\n') + 1)")).otherwise("")
    return table.select(
        F.col(id).cast("long").alias("doc_id"), F.col(id).cast("string").alias("id"), F.substring_index(F.coalesce(text, F.lit("")), "\n", 1).alias("title"), F.coalesce(body, F.lit("")).alias("body")
    )
