"""Sources: text, pages, TEI documents, uploads, prompts, canonical JSON."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from ..functions.text import strip
from ..operators.documents import needs_ocr
from .tei import parse_tei

MOST_BYTES = 50 * 1024 * 1024
CANONICAL_DDL = (
    "paper_id string, version int, title string, authors array<struct<full_name:string>>, abstract string, references array<string>, "
    "blocks array<struct<block_type:string,page_number:int,section:string,text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>, was_ocred boolean, used_grobid boolean"
)


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path)


def admit(files: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame]:
    """Files (path, length, content) that are PDF by name and content and not too long; the others with a reason."""
    reason = F.when(~F.lower("path").endswith(".pdf"), "not a .pdf file").when(F.col("length") > most_bytes, "too large").when(F.substring("content", 1, 4) != F.lit(b"%PDF"), "no PDF content")
    marked = files.withColumn("reason", reason)
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null").select("path", "length", "reason")


FILE_DDL = (
    "paper_id string, version int, blocks array<struct<block_ordinal:int,block_type:string,page:int,section:string,text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>>>, "
    "pages int, chars long, needs_ocr boolean, was_ocred boolean, xml string, failures array<struct<stage:string,reason:string,lost:boolean>>"
)


@contextmanager
def within(seconds: float | None) -> Iterator[None]:
    """A TimeoutError in what runs longer, where the process has timers (its main thread, not on Windows)."""
    import signal
    import threading

    if seconds is None or not hasattr(signal, "setitimer") or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_):
        raise TimeoutError(f"longer than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def processed_files(
    files: DataFrame,
    parser: Callable[[], Callable[[bytes], list[dict]]],
    ocr: Callable[[], Callable[[bytes], bytes]] | None = None,
    metadata: Callable[[], Callable[[bytes], str]] | None = None,
    least_chars: int = 100,
    seconds: float | None = None,
) -> DataFrame:
    """One row (FILE_DDL) for each file of files (paper_id, version, content), in one pass through the plug-ins.

    A file is parsed once; if its pages have too little text for their number, OCR makes another of it and that one is
    parsed; then the metadata service gives its XML. Blank blocks go; texts are stripped. A plug-in is made once in each
    Python worker.

    What fails, or takes longer than `seconds`, is a row's failures (stage, reason), never the job's: a file without
    content or that can't be parsed is lost; without OCR or metadata a document goes on with what there is, and so it does
    when the parser fails on what OCR made. Repeated rows are processed each."""

    def run(frames):
        import pandas as pd

        # a plug-in that can't be made is a failure of each file that needs it
        made: dict[str, Callable] = {}

        def use(name: str, factory: Callable[[], Callable], content: bytes):
            with within(seconds):
                if name not in made:
                    made[name] = factory()
                return made[name](content)

        def blocks_of(content: bytes) -> list[dict]:
            out = []
            for b in use("parse", parser, content):
                text = (b.get("text") or "").strip()
                if text:
                    out.append({"block_ordinal": len(out), "block_type": b.get("block_type", "paragraph"), "page": b.get("page"), "section": b.get("section"), "text": text, "bbox": b.get("bbox")})
            return out

        def measured(blocks: list[dict]) -> tuple[int, int]:
            return max(1, len({b["page"] for b in blocks if b["page"] is not None})), sum(len(b["text"]) for b in blocks)

        def one(paper, version, content) -> tuple:
            failures: list[dict] = []

            def tried(stage: str, lost: bool, call: Callable):
                try:
                    return call()
                except Exception as e:
                    failures.append({"stage": stage, "reason": str(e) or type(e).__name__, "lost": lost})

            if content is None or not len(content):
                return paper, version, None, None, None, None, None, None, [{"stage": "read", "reason": "no content", "lost": True}]
            content = bytes(content)
            blocks = tried("parse", True, lambda: blocks_of(content))
            if blocks is None:
                return paper, version, None, None, None, None, None, None, failures
            pages, chars = measured(blocks)
            needed, was_ocred = chars / pages < least_chars, False
            if needed and ocr is None:
                failures.append({"stage": "ocr", "reason": "no OCR is installed", "lost": False})
            elif needed and (scanned := tried("ocr", False, lambda: bytes(use("ocr", ocr, content)))) is not None:
                again = tried("parse after ocr", False, lambda: blocks_of(scanned))
                if again is not None:
                    content, blocks, was_ocred = scanned, again, True
                    pages, chars = measured(blocks)
            xml = tried("metadata", False, lambda: use("metadata", metadata, content)) if metadata is not None else None
            return paper, version, blocks, pages, chars, needed, was_ocred, xml, failures

        names = [f.split(" ")[0] for f in ("paper_id", "version", "blocks", "pages", "chars", "needs_ocr", "was_ocred", "xml", "failures")]
        for f in frames:
            yield pd.DataFrame([one(*row) for row in zip(f["paper_id"], f["version"], f["content"], strict=True)], columns=names, dtype=object)

    return files.select(F.col("paper_id").cast("string"), F.col("version").cast("int"), "content").mapInPandas(run, FILE_DDL)


def parsed_blocks(files: DataFrame, parser: Callable[[], Callable[[bytes], list[dict]]], key: Column | None = None, version: Column | None = None) -> DataFrame:
    """Blocks of binary files by a plug-in: parser() makes, in each Python worker, a function from bytes to blocks in
    reading order (block_type, page, section, text, bbox). Blank blocks go; texts are stripped; a file that is null, empty
    or can't be parsed has none."""
    rows = files.select((key if key is not None else F.col("path")).alias("paper_id"), (version if version is not None else F.lit(1)).alias("version"), "content")
    return processed_files(rows, parser, least_chars=0).select("paper_id", "version", F.inline("blocks")).select("paper_id", "version", "block_ordinal", "block_type", "page", "section", "text", "bbox")


def page_statistics(blocks: DataFrame) -> DataFrame:
    """pages, chars and needs_ocr of each paper."""
    stats = blocks.groupBy("paper_id").agg(F.count_distinct("page").alias("pages"), F.sum(F.char_length("text")).alias("chars"))
    return stats.withColumn("needs_ocr", needs_ocr(F.col("pages"), F.col("chars")))


def html_blocks(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A block for each heading and paragraph of web pages: paper_id, block_ordinal, block_type, text. Scripts, styles and
    comments go; tags within a block go; white space collapses."""
    bare = F.regexp_replace(F.col(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    found = F.regexp_extract_all(bare, F.lit(r"(?is)<(h[1-6]|p|li|title)\b[^>]*>(.*?)</\1\s*>"), F.lit(0))
    rows = pages.select(F.col(key).cast("string").alias("paper_id"), F.posexplode(found).alias("block_ordinal", "raw"))
    text = F.trim(F.regexp_replace(F.regexp_replace("raw", r"(?s)<[^>]*>", " "), r"(?U)\s+", " "))
    kind = F.when(F.col("raw").rlike("(?i)^<(h[1-6]|title)"), "heading").otherwise("paragraph")
    return rows.select("paper_id", "block_ordinal", kind.alias("block_type"), text.alias("text")).where("text <> ''")


def fetched(documents: DataFrame, client: Callable[[], Callable[[bytes], str]], content: str = "content") -> DataFrame:
    """documents with xml and xml_error of a service: client() makes a callable in each Python worker; a failure leaves
    the document without metadata."""
    schema = StructType([*documents.schema.fields, StructField("xml", StringType()), StructField("xml_error", StringType())])

    def run(frames):
        call = client()
        for f in frames:
            got = []
            for c in f[content]:
                try:
                    got.append((call(bytes(c)), None))
                except Exception as e:
                    got.append((None, str(e)))
            yield f.assign(xml=[g[0] for g in got], xml_error=[g[1] for g in got])

    return documents.mapInPandas(run, schema)


def ocr_by_command(program: str = "ocrmypdf", timeout: float = 120) -> Callable[[], Callable[[bytes], bytes]] | None:
    """A plug-in for with_ocr that runs a command-line program on each file; None where the program isn't installed."""
    import shutil

    if shutil.which(program) is None:
        return None

    def make() -> Callable[[bytes], bytes]:
        import subprocess
        import tempfile
        from pathlib import Path

        def run(content: bytes) -> bytes:
            with tempfile.TemporaryDirectory() as d:
                source, target = Path(d, "in.pdf"), Path(d, "out.pdf")
                source.write_bytes(content)
                subprocess.run([program, "--quiet", "--force-ocr", source, target], check=True, timeout=timeout, capture_output=True)
                return target.read_bytes()

        return run

    return make


def with_ocr(files: DataFrame, needed: Column, ocr: Callable[[], Callable[[bytes], bytes]] | None) -> DataFrame:
    """files with the content that OCR makes of those that need it, was_ocred and ocr_error. Without a plug-in, or where it
    fails, a file goes on as it is."""
    marked = files.withColumn("needs_ocr", F.coalesce(needed, F.lit(False)))
    if ocr is None:
        missing = F.when(F.col("needs_ocr"), F.lit("no OCR is installed"))
        return marked.withColumns({"was_ocred": F.lit(False), "ocr_error": missing})
    schema = StructType([*marked.schema.fields, StructField("was_ocred", BooleanType()), StructField("ocr_error", StringType())])

    def run(frames):
        call = ocr()
        for f in frames:
            content, done, errors = [], [], []
            for c, wanted in zip(f["content"], f["needs_ocr"], strict=True):
                try:
                    content.append(call(bytes(c)) if wanted else c)
                    done.append(bool(wanted))
                    errors.append(None)
                except Exception as e:
                    content.append(c)
                    done.append(False)
                    errors.append(str(e))
            yield f.assign(content=content, was_ocred=done, ocr_error=errors)

    return marked.mapInPandas(run, schema)


def is_alive(client: Callable[[], Callable[[bytes], str]], probe: bytes = b"") -> bool:
    """Whether a service answers at all."""
    try:
        client()(probe)
    except Exception:
        return False
    return True


def read_prompts(spark: SparkSession, folder: str) -> DataFrame:
    """name and prompt of each .txt file of a folder."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    return rows.select(F.regexp_replace("file", r"\.txt$", "").alias("name"), strip(F.col("value")).alias("prompt")).orderBy("name")


def default_prompt(prompts: DataFrame, builtin: str, name: str = "synthesis_extraction", override: str | None = None) -> Column:
    """The override if given, else the preset of that name, else the built-in prompt; a text literal."""
    if override is not None:
        if not override.strip():
            raise FileNotFoundError("the prompt override is empty")
        return F.lit(override.strip())
    row = prompts.where(F.col("name") == name).limit(1).collect()
    return F.lit(row[0]["prompt"] if row else builtin)


def read_canonical(spark: SparkSession, path: str) -> DataFrame:
    """Canonical documents, one JSON object in each file."""
    return spark.read.schema(CANONICAL_DDL).json(path, multiLine=True)


def canonical_blocks(documents: DataFrame) -> DataFrame:
    rows = documents.select("paper_id", "version", F.posexplode("blocks").alias("block_ordinal", "b"))
    return rows.select("paper_id", "version", "block_ordinal", "b.block_type", F.col("b.page_number").alias("page"), "b.section", "b.text", "b.bbox")


def load_documents(documents: DataFrame, stored_blocks: DataFrame) -> DataFrame:
    """Blocks of canonical documents, and stored blocks of the versions that have none."""
    own = canonical_blocks(documents)
    rest = stored_blocks.join(documents.select("paper_id", "version"), ["paper_id", "version"], "left_anti")
    return own.unionByName(rest.select(own.columns))


__all__ = [
    "admit", "canonical_blocks", "default_prompt", "fetched", "html_blocks", "is_alive", "load_documents", "ocr_by_command", "page_statistics", "parse_tei", "parsed_blocks",
    "processed_files", "read_canonical", "read_prompts", "read_uploads", "with_ocr", "within",
]
