"""Scalar text functions as column expressions; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---- Fixed values: they decide which results are right. -------------------------------------
TOKEN = r"[a-z0-9][a-z0-9-]{2,}"
STEM_SUFFIXES = (
    "amento", "azione", "zione", "mente", "abile", "ibile", "ista", "ismo",
    "are", "ere", "ire", "ato", "ata", "ati", "ate", "ito", "ita", "iti", "ite",
    "oso", "osa", "osi", "ose", "ico", "ica", "ici", "iche", "che", "ghe",
    "i", "e", "o", "a",
)
STEM_SUFFIXES_EN = (
    "ations", "ation", "ements", "ement", "ities", "ings", "ity", "able", "ing", "ive",
    "ed", "es", "ly", "al", "s",
)
GRAM_WORD = r"[a-zà-ÿ0-9]+"
QUERY_GRAMS = 64
ACCENTED = "[à-ÿ]"
MONOLINGUAL_BELOW = 0.05
RELATION_KEYWORDS = (
    ("supersedes", ("supersede", "sostituisce", "sostituita da", "replaces", "replaced by",
                    "rimpiazza")),
    ("is-a", ("is-a", "is a", "isa", "tipo di", "è un", "e un", "sottotipo", "kind of",
              "subclass")),
    ("part-of", ("part-of", "part of", "parte di", "fa parte", "componente di")),
    ("contrasts-with", ("contrast", "a differenza", "differisce", "si contrappone", "opposto",
                        "invece di")),
    ("depends-on", ("depend", "dipende", "richiede", "requires", "needs", "si basa",
                    "basato su")),
    ("uses", ("uses", "use", "usa", "utilizza", "sfrutta", "impiega")),
)
SECRET_FILE_NAMES = (
    ".env", ".envrc", ".netrc", ".npmrc", ".pypirc", "credentials", "credentials.json",
    "service-account.json", "secrets.json", "secrets.yaml", "secrets.yml",
)
SECRET_FILE_SUFFIXES = (".pem", ".key", ".pfx", ".p12", ".keystore", ".jks")
SECRET_FILE_PREFIXES = ("id_rsa", "id_ed25519", "id_dsa", ".env.")
# kind -> pattern; (?U) makes \b and \s follow Unicode.
SECRET_PATTERNS = {
    "aws-access-key": r"(?U)\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "private-key-block": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer-token": r"(?iU)\bBearer\s+[A-Za-z0-9._~+/-]{20,}=*",
    "github-token": r"(?U)\bgh[pousr]_[A-Za-z0-9]{20,}\b",
    "slack-token": r"(?U)\bxox[baprs]-[A-Za-z0-9-]{10,}\b",
    "generic-assignment": (
        r"(?iU)\b(?:api[_-]?key|secret|token|passwd|password|client[_-]?secret)\b"
        r"""\s*[:=]\s*["']?[A-Za-z0-9_\-./+]{12,}["']?"""
    ),
}
REFUSAL_MARKERS = (
    "non contiene", "non è possibile", "non e' possibile", "non sono in grado",
    "nessun contesto", "non ci sono informazioni", "non è sufficiente", "non disponibile",
    "i don't know", "i do not know", "cannot answer", "not enough", "no information",
    "non lo so",
)
# ----------------------------------------------------------------------------------------------

# The blanks and line ends of Python's str.split / str.strip / str.splitlines.
_BLANKS = (
    r"\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Visible ASCII is told first: the long class is tried for other characters only.
BLANK = f"[[^!-~]&&[{_BLANKS}]]"
NON_BLANK = f"[!-~[^{_BLANKS}]]"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _prefix_tree(words: tuple[str, ...]) -> str:
    """One pattern for all words that shares their common beginnings."""
    heads = sorted({w[0] for w in words if w})
    branches = [h + _prefix_tree(tuple(w[1:] for w in words if w[:1] == h)) for h in heads]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)})" + ("?" if "" in words else "")


def _cut_suffix(word: Column, suffixes: tuple[str, ...], keep: int) -> Column:
    # A lazy stem followed by the first suffix that reaches the end: the longest suffix wins.
    # The prefix tree makes this several times faster than the plain list of suffixes.
    return F.regexp_replace(word, f"^(.{{{keep},}}?){_prefix_tree(suffixes)}$", "$1")


def stem(word: Column) -> Column:
    """Italian, English, then Italian suffixes once each."""
    for suffixes, keep in ((STEM_SUFFIXES, 3), (STEM_SUFFIXES_EN, 4), (STEM_SUFFIXES, 3)):
        word = _cut_suffix(word, suffixes, keep)
    return word


def stem_it(word: Column) -> Column:
    return _cut_suffix(word, STEM_SUFFIXES, 3)


def raw_tokens(text: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(_col(text)), F.lit(TOKEN), 0)


def count_tokens(text: Column | str) -> Column:
    """The length of ``tokens`` without building it."""
    return F.regexp_count(F.lower(_col(text)), F.lit(TOKEN))


def tokens(text: Column | str) -> Column:
    """Lower-case stemmed words, repeats kept."""
    return F.transform(raw_tokens(text), stem)


def trigrams(text: Column | str) -> Column:
    """Distinct character 3-grams of the words, in order of first sight."""
    words = F.filter(
        F.regexp_extract_all(F.lower(_col(text)), F.lit(GRAM_WORD), 0), lambda w: F.length(w) >= 3
    )
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))
        ),
    )
    return F.array_distinct(F.flatten(grams))


def query_trigrams(text: Column | str) -> Column:
    return F.slice(trigrams(text), 1, QUERY_GRAMS)


def haystack_text(notes_prefix: str = "") -> Column:
    """The weighted search field of a note: title three times, aliases twice."""
    p = notes_prefix
    title, aliases = F.col(f"{p}title"), F.array_join(f"{p}aliases", " ")
    return F.concat_ws(
        " ", title, title, title, aliases, aliases,
        F.array_join(f"{p}tags", " "), F.col(f"{p}retrieval_text"), F.col(f"{p}summary"),
    )


def plain_text() -> Column:
    """The unweighted field used by the single-channel search."""
    return F.concat_ws(
        " ", "title", F.array_join("aliases", " "), F.array_join("tags", " "),
        "retrieval_text", "summary",
    )


def strip(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), rf"^{BLANK}+|{BLANK}+\z", "")


def key(text: Column | str) -> Column:
    """The lookup key of a title or alias."""
    return F.lower(strip(text))


# letters whose capital is written with several, and the one letter that stands for it in a simple mapping
_WIDE = "".join(chr(c) for c in range(128, 0x10000) if len(chr(c).upper()) > 1)
_NARROW = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _WIDE)
_WIDE_CLASS = "".join(c if chr(ord(c) - 1) not in _WIDE else "" if chr(ord(c) + 1) in _WIDE else f"-{c}" for c in _WIDE)


def upper(text: Column | str) -> Column:
    """Capitals letter for letter: sharp s becomes its capital, not SS, so the lower case finds it again."""
    text = _col(text)
    parts = F.regexp_extract_all(text, F.lit(f"[{_WIDE_CLASS}]+|[^{_WIDE_CLASS}]+"), 0)
    by_letter = F.transform(parts, lambda p: F.when(F.contains(F.lit(_WIDE), F.substring(p, 1, 1)), F.translate(p, _WIDE, _NARROW)).otherwise(F.upper(p)))
    return F.when(F.translate(text, _WIDE, "") == text, F.upper(text)).otherwise(F.array_join(by_letter, ""))


def words(text: Column | str) -> Column:
    return F.regexp_extract_all(_col(text), F.lit(f"{NON_BLANK}+"), 0)


def collapse(text: Column | str) -> Column:
    return F.array_join(words(text), " ")


def lines(text: Column | str) -> Column:
    return F.split(_col(text), LINE_END)


def note_slug(title: Column | str) -> Column:
    slug = F.regexp_replace(strip(title), r'[<>:"/\\|?*\x00-\x1f]', "")
    slug = F.regexp_replace(slug, f"{BLANK}+", "-")
    slug = F.regexp_replace(slug, r"^[. ]+|[. ]+\z", "")
    return F.when(slug == "", F.lit("untitled")).otherwise(slug)


def _dash(value: Column, keep: str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(value), f"[^{keep}]+", "-"), r"^-+|-+\z", "")


def node_id(kind: str, value: Column | str) -> Column:
    return F.concat(F.lit(f"{kind}:"), _dash(_col(value), "a-z0-9._/-"))


def domain_slug(name: Column | str, prefix: str = "dom-") -> Column:
    slug = _dash(_col(name), "a-z0-9")
    return F.concat(F.lit(prefix), F.when(slug == "", F.lit("x")).otherwise(slug))


def type_id(name: Column | str) -> Column:
    return F.concat(F.lit("rel:"), _dash(_col(name), "a-z0-9-"))


def content_hash(text: Column | str) -> Column:
    return F.sha2(F.encode(_col(text), "UTF-8"), 256)


def source_hash(text: Column | str) -> Column:
    return F.concat(F.lit("sha256:"), content_hash(text))


def digest8(text: Column | str) -> Column:
    return F.substring(content_hash(text), 1, 8)


def _first_piece(text: Column | str, cut: str, clean, usable, few: int = 16) -> Column:
    """The first usable piece between cuts, or null. More than the first piece, and then the first ``few``, are cleaned only
    if none of them is usable."""
    first = lambda pieces: F.try_element_at(F.filter(F.transform(pieces, clean), usable), F.lit(1))
    begin = [first(F.slice(F.split(_col(text), cut, n + 1), 1, n)) for n in (1, few)]
    return F.coalesce(*begin, first(F.split(_col(text), cut)))


def first_line(text: Column | str, limit: int = 200) -> Column:
    """The first usable line: list markers stripped, fences, tables and images skipped."""
    line = _first_piece(
        text, LINE_END, lambda v: strip(F.regexp_replace(strip(v), r"^[>\-*| ]+", "")),
        lambda v: (v != "") & ~v.rlike(r"^(?:```|\||!\[)"),
    )
    return F.substring(F.coalesce(line, strip(text)), 1, limit)


def first_paragraph(text: Column | str, limit: int = 240) -> Column:
    """The first paragraph that is not a heading, blanks collapsed."""

    def clean(v):
        # the beginning of a block decides, unless it is mostly blank; an array of one, so it is collapsed once
        enough = lambda c: F.when((F.length(c) >= limit) | (F.length(v) <= 2 * limit), c).otherwise(collapse(v))
        return F.get(F.transform(F.array(collapse(F.substring(v, 1, 2 * limit))), enough), 0)

    block = _first_piece(text, "\n\n", clean, lambda v: (v != "") & ~v.startswith("#"), few=4)
    return F.substring(F.coalesce(block, F.lit("")), 1, limit)


def estimate_tokens(text: Column | str) -> Column:
    value = _col(text)
    return F.greatest(F.floor(F.length(value) / 4), F.regexp_count(value, F.lit(f"{NON_BLANK}+")))


def redact(text: Column | str) -> Column:
    """struct(text, count) with likely secrets replaced, kind by kind in fixed order."""
    value, count = _col(text), F.lit(0)
    for kind, pattern in SECRET_PATTERNS.items():
        count = count + F.regexp_count(value, F.lit(pattern))
        value = F.regexp_replace(value, pattern, f"[REDACTED:{kind}]")
    return F.struct(value.alias("text"), count.alias("count"))


def find_secrets(texts: DataFrame) -> DataFrame:
    """doc_id, kind, line of every likely secret, never its value; two on one line are two rows.

    A mark is put before every match; a line then has as many secrets as marks.
    """
    clean = F.translate("text", "\x01", "\x02")

    def found(kind: str, pattern: str) -> Column:
        lines = F.split(F.regexp_replace(clean, pattern, "\x01$0"), "\n")
        marks = lambda v: F.length(v) - F.length(F.replace(v, F.lit("\x01"), F.lit("")))
        rows = F.transform(lines, lambda v, i: F.struct(F.lit(kind).alias("kind"), (i + 1).alias("line"), marks(v).alias("n")))
        none = F.expr("cast(array() as array<struct<kind:string,line:int,n:int>>)")
        return F.when(F.col("text").rlike(pattern), F.filter(rows, lambda r: r["n"] > 0)).otherwise(none)

    listed = texts.select("doc_id", F.explode(F.concat(*[found(*p) for p in SECRET_PATTERNS.items()])).alias("f"))
    return listed.select("doc_id", "f.kind", "f.line", F.explode(F.sequence(F.lit(1), "f.n"))).drop("col")


def is_secret_file(name: Column | str) -> Column:
    low = F.lower(_col(name))
    hit = low.isin(*SECRET_FILE_NAMES)
    for prefix in SECRET_FILE_PREFIXES:
        hit = hit | low.startswith(prefix)
    # a suffix needs a stem before it, as in path suffixes
    return hit | low.rlike(r"^.+(?:" + "|".join(s.replace(".", r"\.") for s in SECRET_FILE_SUFFIXES) + r")$")


_ISO = (
    r"^(\d{4}-\d{2}-\d{2})(?:.(\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d{1,6})\d*)?)?"
    r"(Z|[+-]\d{2}(?::?\d{2})?)?$"
)


def parse_when(text: Column | str) -> Column:
    """struct(instant, warning, error) for a year, month, day or ISO date-time.

    A partial date means the end of that period. A date-time without offset is read in the
    session time zone and says so in ``warning``.
    """
    raw = strip(text)
    dashed = F.regexp_replace(raw, r"^(\d{4})(\d{2})(\d{2})(?=$|\D)", "$1-$2-$3")
    part = lambda i: F.regexp_extract(dashed, _ISO, i)
    filled = lambda i: F.when(part(i) == "", F.lit("00")).otherwise(part(i))
    micros = F.rpad(part(5), 6, "0")
    zone = F.regexp_replace(part(6), r"^([+-]\d{2}):?(\d{2})?$", "$1:$2")
    zone = F.when(zone.endswith(":"), F.concat(zone, F.lit("00"))).otherwise(zone)
    iso = F.concat(
        part(1), F.lit(" "), filled(2), F.lit(":"), filled(3), F.lit(":"), filled(4),
        F.lit("."), micros, zone,
    )
    end = lambda day: F.try_to_timestamp(F.concat(day, F.lit(" 23:59:59")))
    year = end(F.concat(raw, F.lit("-12-31")))
    month = F.try_to_timestamp(F.concat(raw, F.lit("-01"))) + F.expr("interval 1 month")
    instant = (
        F.when(raw.rlike(r"^\d{4}$"), year)
        .when(raw.rlike(r"^\d{4}-\d{2}$"), month - F.expr("interval 1 second"))
        .when(raw.rlike(r"^\d{4}-\d{2}-\d{2}$"), end(raw))
        .when(dashed.rlike(_ISO), F.try_to_timestamp(iso))
    )
    partial = raw.rlike(r"^\d{4}(-\d{2}){0,2}$")
    naive = ~partial & dashed.rlike(_ISO) & (part(6) == "")
    return F.struct(
        instant.alias("instant"),
        F.when(
            naive & instant.isNotNull(),
            F.concat(F.lit("naive datetime '"), raw, F.lit("' interpreted as local time")),
        ).alias("warning"),
        F.when(
            instant.isNull(), F.concat(F.lit("invalid as-of time '"), raw, F.lit("'"))
        ).alias("error"),
    )


def fixed_relation(relation: Column | str) -> Column:
    """The fixed type of a relation surface, NULL when no keyword occurs in it."""
    low = key(relation)
    chain = F.when(low == "", F.lit("related"))
    for name, keywords in RELATION_KEYWORDS:
        hit = low.contains(keywords[0])
        for word in keywords[1:]:
            hit = hit | low.contains(word)
        chain = chain.when(hit, F.lit(name))
    return chain


def surface_key(surface: Column | str) -> Column:
    return F.array_join(tokens(surface), " ")


def is_refusal(answer: Column | str) -> Column:
    low = F.lower(_col(answer))
    hit = low.contains(REFUSAL_MARKERS[0])
    for marker in REFUSAL_MARKERS[1:]:
        hit = hit | low.contains(marker)
    return hit


def collection_marker(kind: Column | str, name: Column | str) -> Column:
    kind, name = _col(kind), _col(name)
    return (
        F.when(kind == "central", F.lit("[central]"))
        .when(kind == "archive", F.concat(F.lit("[archive:"), name, F.lit("]")))
        .otherwise(F.concat(F.lit("[project:"), name, F.lit("]")))
    )


def note_brief(limit: int = 360) -> Column:
    """One prompt line for a note: id, title, summary and the head of the body."""
    body = F.substring(strip(F.array_join(F.transform("body_sections", lambda s: s["value"]), " ")), 1, limit)
    return F.concat(
        F.lit("- "), F.col("note_id"), F.lit(" | "), F.col("title"), F.lit(" — "),
        F.col("summary"), F.lit(" — "), body,
    )


def validation_errors() -> Column:
    return F.array_compact(
        F.array(
            F.when(strip("title") == "", F.lit("title is required")),
            F.when(strip("retrieval_text") == "", F.lit("retrieval_text is required")),
            F.when(F.size("sources") <= 0, F.lit("note has no sources")),
            F.when(
                (F.col("confidence") < 0) | (F.col("confidence") > 1),
                F.lit("confidence must be between 0 and 1"),
            ),
        )
    )


def non_ascii_share(*columns: str) -> Column:
    """Aggregate: share of rows with an accented letter, 4 decimals, 0 for no rows."""
    text = F.concat_ws(" ", *columns)
    return F.coalesce(F.round(F.avg(text.rlike(ACCENTED).cast("double")), 4), F.lit(0.0))
