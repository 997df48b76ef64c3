"""Text shapes as column expressions: page text, chunks, frontmatter, code digests, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.functions import text as T

# ---- Fixed values ----------------------------------------------------------------------------
CHUNK_CHARS = 20_000
CHUNK_OVERLAP = 1_000
DIGEST_HEAD_LINES = 30
DIGEST_SIGNATURES = 40
DIGEST_CHARS = 8000
SIGNATURE = r"^\s*(def |class |function |func |fn |public |export |interface |struct |impl )"
TOOL_HINT_CHARS = 60
NAMED_ENTITIES = {
    "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "middot": "·",
    "hellip": "…", "ndash": "–", "mdash": "—", "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”",
    "laquo": "«", "raquo": "»", "bull": "•", "euro": "€", "times": "×", "deg": "°",
}
# ----------------------------------------------------------------------------------------------
DOC_OPENING = "(?:[rRuU]?(?:\"\"\"|'''|\"|')\\s*)"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


# ---- pages -----------------------------------------------------------------------------------


def _decoder(base: int, mark: str):
    """Puts the character of one numeric reference into a text."""

    def decode(done: Column, code: Column) -> Column:
        value = F.decode(F.unhex(F.lpad(F.conv(code, base, 16), 8, "0")), "UTF-32")
        reference = F.concat(F.lit(f"(?i){mark}"), code, F.lit(r"(?![0-9a-f]);?"))
        return F.regexp_replace(done, reference, F.regexp_replace(value, r"([\\$])", r"\\$1"))

    return decode


def unescape(text: Column) -> Column:
    """Character references decoded: numeric ones and the common names, ``&amp;`` last."""
    done = text
    for base, mark, pattern in ((10, "&#", r"&#(\d{1,6})"), (16, "&#x", r"&#[xX]([0-9a-fA-F]{1,5})")):
        codes = F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), 1))
        done = F.aggregate(codes, done, _decoder(base, mark))
    for name, value in NAMED_ENTITIES.items():
        done = F.replace(done, F.lit(f"&{name};"), F.lit(value))
    return F.when(text.contains("&"), F.replace(done, F.lit("&amp;"), F.lit("&"))).otherwise(text)


def html_to_text(html: Column | str) -> Column:
    """The stripped, non-empty text nodes outside script and style, one per line."""
    page = F.coalesce(_col(html), F.lit(""))
    for hidden in ("script", "style"):
        page = F.regexp_replace(page, rf"(?is)<{hidden}\b[^>]*>.*?(?:</{hidden}\s*>|\z)", "<x>")
    page = F.regexp_replace(page, r"(?s)<!--.*?(?:-->|\z)|<[!?][^>]*>", "<x>")
    nodes = F.transform(F.split(page, r"</?[a-zA-Z][^<>]*>"), lambda v: T.strip(unescape(v)))
    return F.array_join(F.filter(nodes, lambda v: v != ""), "\n")


# ---- chunks ----------------------------------------------------------------------------------


def chunk_bounds(text: Column, limit: int) -> Column:
    """Where chunks begin, and the end of the text with its closing blank line, as offsets.

    A paragraph ends behind its blank line. A chunk is closed before the paragraph that would take it past the limit; what is
    longer than the limit by itself is closed every ``limit`` characters.
    """
    sizes = F.transform(F.split(text, "\n\n"), lambda p: F.char_length(p) + 2)
    empty = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("begin"), F.lit(0).alias("at"))

    def add(state: Column, size: Column) -> Column:
        close = (state["at"] > state["begin"]) & (state["at"] + size - state["begin"] > limit)
        begin = F.when(close, state["at"]).otherwise(state["begin"])
        hard = F.greatest(F.lit(0), F.ceil((state["at"] + size - begin) / F.lit(limit)).cast("int") - 1)
        steps = F.when(hard > 0, F.transform(F.sequence(F.lit(1), F.greatest(hard, F.lit(1))), lambda k: begin + k * limit)).otherwise(
            F.array().cast("array<int>")
        )
        soft = F.when(close, F.array(state["at"])).otherwise(F.array().cast("array<int>"))
        return F.struct(
            F.when(close | (hard > 0), F.concat(state["cuts"], soft, steps)).otherwise(state["cuts"]).alias("cuts"), (begin + hard * limit).alias("begin"), (state["at"] + size).alias("at")
        )

    return F.aggregate(sizes, empty, add, lambda s: F.concat(F.array(F.lit(0)), s["cuts"], F.array(s["at"])))


def base_chunks(text: Column | str, limit: int = CHUNK_CHARS) -> Column:
    """Paragraphs packed up to the limit, longer ones cut hard; a blank last chunk is dropped."""
    text = _col(text)
    whole = F.concat(text, F.lit("\n\n"))
    bounds = chunk_bounds(text, limit)
    pieces = F.zip_with(
        F.slice(bounds, 1, F.size(bounds) - 1), F.slice(bounds, 2, F.size(bounds) - 1),
        lambda a, b: T.strip(F.substring(whole, a + 1, b - a)),
    )
    last = F.element_at(pieces, -1)
    many = F.when(last == "", F.slice(pieces, 1, F.size(pieces) - 1)).otherwise(pieces)
    return F.when(F.char_length(text) <= limit, F.array(text)).otherwise(many)


def tail_of(chunk: Column, overlap: int) -> Column:
    """The longest run of whole last paragraphs within the overlap, else the end of the last one."""
    sizes = F.reverse(F.transform(F.split(chunk, "\n\n"), F.char_length))
    none = F.struct(F.lit(-2).alias("total"), F.lit(-1).alias("best"))

    def add(state: Column, size: Column) -> Column:
        total = state["total"] + size + 2
        return F.struct(total.alias("total"), F.when(total <= overlap, total).otherwise(state["best"]).alias("best"))

    best = F.aggregate(sizes, none, add, lambda s: s["best"])
    length = F.when(best >= 0, best).otherwise(F.lit(overlap))
    return F.when(length > 0, F.right(chunk, length)).otherwise(F.lit(""))


def chunks_of(text: Column | str, limit: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> Column:
    """The base chunks, each later one led by the tail of the base chunk before it."""
    base = base_chunks(text, limit)
    if overlap <= 0:
        return base

    def led(chunk: Column, number: Column) -> Column:
        tail = tail_of(F.get(base, number - 1), overlap)
        return F.when((number == 0) | (tail == ""), chunk).otherwise(F.concat(tail, F.lit("\n\n"), chunk))

    return F.transform(base, led)


def split_chunks(texts: DataFrame, limit: int = CHUNK_CHARS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """doc_id, chunk_no, chunk."""
    listed = texts.withColumn("__base", base_chunks("text", limit))
    base = F.col("__base")
    before = F.transform(base, lambda c, k: F.when(k > 0, F.get(base, k - 1)))
    rows = listed.select("doc_id", F.posexplode(F.arrays_zip(base.alias("chunk"), before.alias("before"))).alias("chunk_no", "c"))
    tail = tail_of(F.col("c.before"), overlap) if overlap > 0 else F.lit("")
    chunk = F.when(F.col("c.before").isNull() | (tail == ""), F.col("c.chunk")).otherwise(F.concat(tail, F.lit("\n\n"), "c.chunk"))
    return rows.select("doc_id", "chunk_no", chunk.alias("chunk"))


def chunk_counts(texts: DataFrame, limit: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, chars, chunks: the overlap never changes the number of chunks."""
    return texts.select("doc_id", F.length("text").alias("chars"), F.size(base_chunks("text", limit)).alias("chunks"))


# ---- frontmatter -----------------------------------------------------------------------------


def _bare(value: Column) -> Column:
    return F.regexp_replace(T.strip(value), r"^[\"']+|[\"']+\z", "")


def _field(head: Column, name: str) -> Column:
    """The text right of the last ``name:`` line; null without such a line."""
    found = F.regexp_extract_all(head, F.lit(rf"(?im)^{name}:[ \t]*(.*)$"), 1)
    return T.strip(F.try_element_at(found, F.lit(-1)))


def _list_field(head: Column, name: str) -> Column:
    """A value, a bracketed list or the dash lines below the last ``name:`` line."""
    value = _field(head, name)
    below = F.regexp_extract_all(head, F.lit(rf"(?im)^{name}:[ \t]*((?:\r?\n[ \t]*(?:[ \t]-[^\n]*)?(?=\n|\z))*)"), 1)
    items = F.regexp_extract_all(F.coalesce(F.try_element_at(below, F.lit(-1)), F.lit("")), F.lit(r"(?m)^[ \t]+-[ \t]*(\S[^\n]*)$"), 1)
    inner = F.split(F.regexp_extract(value, r"^\[(.*)\]\z", 1), ",")
    many = F.when(value == "", items).when(value.rlike(r"^\[.*\]\z"), inner).otherwise(F.array(value))
    kept = F.filter(F.transform(many, _bare), lambda v: T.strip(v) != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def vault_meta(files: DataFrame) -> DataFrame:
    """path, stem, title, aliases, tags, body of Markdown files with loose frontmatter."""
    opened = F.col("text").startswith("---") & (F.locate("\n---", F.col("text"), 4) > 0)
    close = F.locate("\n---", F.col("text"), 4)
    head = F.when(opened, F.expr("substring(text, 4, locate('\\n---', text, 4) - 4)")).otherwise(F.lit(""))
    body = F.when(opened, F.substring("text", close + 4, F.length("text"))).otherwise(F.col("text"))
    stem = F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^./]*\z", "")
    told = F.coalesce(_bare(_field(head, "title")), F.lit(""))
    title = F.when((told == "") | told.rlike(r"[\[\]{}\n]"), stem).otherwise(told)
    tags = F.transform(_list_field(head, "tags"), lambda t: F.regexp_replace(t, r"^#+", ""))
    return files.select(
        "path", stem.alias("stem"), title.alias("title"), _list_field(head, "aliases").alias("aliases"),
        tags.alias("tags"), T.strip(body).alias("body"),
    )


# ---- code ------------------------------------------------------------------------------------


def _python_digest(text: Column) -> Column:
    """Docstring, then public functions and classes at the margin with the first line of theirs, and public methods."""
    doc = F.regexp_extract(text, r"(?s)\A(?:\s|#[^\n]*\n)*(\"\"\"|''')(.*?)\1", 2)
    # a definition, the rest of its head, and the first words of a docstring below it
    entry = (
        r"(?m)^(?:(?:async[ ]+)?(def|class)[ ]+([A-Za-z]\w*)[^\n]*:[ \t]*(?:#[^\n]*)?(?:\n\s+" + DOC_OPENING + r"([^\n\"']*))?"
        r"|(?:async[ ]+)?(def|class)[ ]+([A-Za-z]\w*)[^\n]*|[ ]{4}(?:async[ ]+)?def[ ]+([A-Za-z]\w*)|(?:async[ ]+)?(?:def|class)[ ]+_\w*)"
    )
    found = F.regexp_extract_all(text, F.lit(entry), 0)
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("owner"))

    def add(state: Column, item: Column) -> Column:
        method = F.regexp_extract(item, r"^[ ]{4}(?:async[ ]+)?def[ ]+(\w+)", 1)
        kind = F.regexp_extract(item, r"^(?:async[ ]+)?(def|class)", 1)
        name = F.regexp_extract(item, r"^(?:async[ ]+)?(?:def|class)[ ]+([A-Za-z]\w*)", 1)
        about = T.strip(F.regexp_extract(item, r"\n\s+" + DOC_OPENING + r"([^\n\"']*)", 1))
        line = (
            F.when((method != "") & (state["owner"] != ""), F.concat(F.lit("  def "), state["owner"], F.lit("."), method))
            .when((method == "") & (name != ""), F.concat(kind, F.lit(" "), name, F.lit(": "), about))
        )
        owner = F.when(method != "", state["owner"]).when(kind == "class", name).otherwise(F.lit(""))
        return F.struct(F.concat(state["out"], F.filter(F.array(line), lambda v: v.isNotNull())).alias("out"), owner.alias("owner"))

    entries = F.aggregate(found, start, add, lambda s: s["out"])
    told = F.when(T.strip(doc) != "", F.array(F.concat(F.lit("Docstring: "), T.strip(doc)))).otherwise(F.array().cast("array<string>"))
    return F.concat(told, entries)


def code_digest(path: Column | str, text: Column | str) -> Column:
    """The outline of a Python file; of other files, and of Python without any definition, head lines and signatures."""
    path, text = _col(path), _col(text)
    module = F.array(F.concat(F.lit("Modulo: "), path))
    lines = F.transform(T.lines(text), lambda v: F.regexp_replace(v, r"\s+\z", ""))
    later = F.filter(F.slice(lines, DIGEST_HEAD_LINES + 1, F.greatest(F.size(lines), F.lit(1))), lambda v: v.rlike(SIGNATURE))
    plain = F.concat(module, F.slice(lines, 1, DIGEST_HEAD_LINES), F.slice(later, 1, DIGEST_SIGNATURES))
    rest = F.substring(F.array_join(plain, "\n"), 1, DIGEST_CHARS)
    outline = _python_digest(text)
    is_python = F.lower(path).endswith(".py") & (F.size(outline) > 0)
    return F.when(is_python, F.array_join(F.concat(module, outline), "\n")).otherwise(rest)


# ---- transcripts -----------------------------------------------------------------------------


def _said(value: Column) -> Column:
    """Text of a content value: a string, or blocks of text, tool calls and tool results."""
    get = lambda v, path: F.try_variant_get(v, path, "string")

    def block(b: Column) -> Column:
        kind = get(b, "$.type")
        hints = F.array(get(b, "$.input.file_path"), get(b, "$.input.path"), get(b, "$.input.command"))
        hint = F.coalesce(F.try_element_at(F.filter(hints, lambda h: h != ""), F.lit(1)), F.lit(""))
        call = F.concat(F.lit("[tool "), F.coalesce(get(b, "$.name"), F.lit("tool")), F.lit(": "), F.substring(hint, 1, TOOL_HINT_CHARS), F.lit("]"))
        text = (
            F.when(kind == "text", T.strip(F.coalesce(get(b, "$.text"), F.lit(""))))
            .when(kind == "tool_use", call)
            .when(kind == "tool_result", F.lit("[tool result]"))
            .when(F.schema_of_variant(b) == "STRING", T.strip(get(b, "$")))
        )
        return F.coalesce(text, F.lit(""))

    blocks = F.transform(F.try_variant_get(value, "$", "array<variant>"), block)
    joined = F.array_join(F.filter(blocks, lambda v: v != ""), " ")
    return F.coalesce(F.when(F.schema_of_variant(value).startswith("ARRAY"), joined), T.strip(get(value, "$")), F.lit(""))


def compress_transcript(text: Column | str) -> Column:
    """JSON lines as ``role: text`` lines; a text whose first line is no JSON passes through."""
    text = _col(text)
    lines = F.filter(F.transform(T.lines(text), T.strip), lambda v: v != "")
    entries = F.filter(F.transform(lines, F.try_parse_json), lambda v: v.isNotNull())

    def line(entry: Column) -> Column:
        role = F.coalesce(*[F.nullif(F.try_variant_get(entry, f"$.{k}", "string"), F.lit("")) for k in ("role", "type")], F.lit("?"))
        content = F.coalesce(F.try_variant_get(entry, "$.content", "variant"), F.try_variant_get(entry, "$.text", "variant"))
        said = F.coalesce(_said(content), F.lit(""))
        return F.when(F.schema_of_variant(entry).startswith("OBJECT") & (said != ""), F.concat(role, F.lit(": "), said))

    told = F.array_join(F.filter(F.transform(entries, line), lambda v: v.isNotNull()), "\n")
    first = F.try_element_at(lines, F.lit(1))
    return F.when(first.isNotNull() & F.try_parse_json(first).isNull(), T.strip(text)).otherwise(told)
