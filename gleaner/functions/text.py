"""Column builders over text: identifier-aware tokens, ids, hashes and display helpers. All stay in the JVM; null gives null unless said otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UP, LOW = "[A-Z]", "[a-z]"
LEXICAL = r"\w+(?:\.\w+)*"  # Java's word characters are ASCII
CAMEL = f"{UP}+(?={UP}{LOW}|[0-9_]|$)|{UP}?{LOW}+|[0-9]+"
LINK, FENCE = r"\x5B([^\x5D]+)\x5D\x28[^\x29]+\x29", "(?s)`{3}(?:python)?\n(.*?)`{3}"
NAMESPACE = "a1b2c3d4e5f67890abcdef1234567890"


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def lexical_tokens(text: Column) -> Column:
    """Dotted ASCII identifiers, in order."""
    return _all(text, LEXICAL)


def dot_parts(token: Column) -> Column:
    return F.filter(F.split(token, r"\."), lambda p: p != "")


def name_parts(token: Column) -> Column:
    """Lower-case pieces between underscores and camel humps."""
    return F.transform(F.flatten(F.transform(F.split(token, "_"), lambda s: _all(s, CAMEL))), F.lower)


def token_terms(token: Column) -> Column:
    """What one lexical token counts as: itself, its dotted parts and their pieces, each once."""
    parts = F.flatten(F.transform(dot_parts(token), lambda p: F.concat(F.array(F.lower(p)), name_parts(p))))
    return F.array_distinct(F.concat(F.array(F.lower(token)), parts))


def tokens(text: Column) -> Column:
    """The flat token list; terms are distinct within a lexical token and repeat across tokens."""
    return F.flatten(F.transform(lexical_tokens(text), token_terms))


def simple_tokens(text: Column) -> Column:
    """Pieces between anything that isn't a word character, underscores and camel humps; no whole identifiers."""
    humps = F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9]+", " "), f"(?<=[a-z0-9])(?={UP})|(?<={UP})(?={UP}{LOW})", " ")
    return F.filter(F.split(F.lower(humps), " "), lambda t: t != "")


def whitespace_tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def word_set(text: Column) -> Column:
    return F.array_distinct(_all(F.lower(text), "[a-z0-9_]+"))


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's words that the text has; 0 for a query without words."""
    asked = word_set(query)
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, word_set(text))) / F.size(asked)).otherwise(F.lit(0.0))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """RFC 4122 version 5, in its usual form with dashes."""
    digest = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8))), 1, 1)
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def id63(text: Column) -> Column:
    """A non-negative 63-bit number from the head of the SHA-256."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 16), 16, 10).cast("decimal(20,0)").__mod__(F.lit("9223372036854775808").cast("decimal(20,0)")).cast("long")


def relative_source(path: Column) -> Column:
    """The path from the last directory named src on; unchanged where there is none."""
    return F.regexp_replace(path, r"^(.*/)?(?=src/)", "")


def coarse_id(path: Column, module: Column, qualname: Column) -> Column:
    return uuid5(F.concat(F.lit("code:"), relative_source(path), F.lit(":"), _full_name(module, qualname), F.lit(":coarse:0")))


def fine_id(path: Column, module: Column, qualname: Column, window: Column) -> Column:
    return uuid5(F.concat(F.lit("code:"), relative_source(path), F.lit(":"), _full_name(module, qualname), F.lit(":fine:"), window.cast("string")))


def _full_name(module: Column, qualname: Column) -> Column:
    dotted = F.concat(module, F.lit("."))
    return F.when(F.startswith(qualname, dotted), qualname).otherwise(F.concat(dotted, qualname))


def paper_id(source: Column, section: Column, text: Column) -> Column:
    return uuid5(F.concat(F.lit("paper:"), source, F.lit(":"), section, F.lit(":"), F.substring(content_hash(text), 1, 16)))


def readme_id(title: Column, paragraph: Column) -> Column:
    return uuid5(F.concat(F.lit("readme:README.md:"), title, F.lit(":coarse:"), paragraph.cast("string")))


def module_name(path: Column, package: str) -> Column:
    """Dotted path from the first part equal to the package's name; the file's stem where no part is."""
    parts = F.split(F.regexp_replace(path, r"\.py$", ""), "/")
    at = F.array_position(parts, package)
    dotted = F.array_join(F.when(at > 0, F.slice(parts, at.cast("int"), F.size(parts))).otherwise(F.slice(parts, -1, 1)), ".")
    return F.regexp_replace(dotted, r"\.__init__$", "")


def slugify(text: Column, words: int = 6, most: int = 40) -> Column:
    parts = F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "-"), lambda w: w != "")
    slug = F.regexp_replace(F.substring(F.array_join(F.slice(parts, 1, words), "-"), 1, most), "-+$", "")
    return F.when(slug == "", F.lit("session")).otherwise(slug)


def preview(text: Column, most: int = 250) -> Column:
    """Links reduced to their words, one line, cut with an ellipsis."""
    plain = F.trim(F.replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), LINK, "$1"), F.lit("\n"), F.lit(" ")))
    return F.when(F.length(plain) > most, F.concat(F.substring(plain, 1, most), F.lit("…"))).otherwise(plain)


def parse_ref(ref: Column) -> Column:
    """`path:lo-hi`, `path:line` or `path` as struct(file, start, end)."""
    lines = F.split(F.get(F.split(ref, ":"), F.lit(1)), "-", 2)
    start = F.get(lines, F.lit(0)).try_cast("int")
    return F.struct(F.get(F.split(ref, ":"), F.lit(0)).alias("file"), start.alias("start"), F.coalesce(F.get(lines, F.lit(1)).try_cast("int"), start).alias("end"))


def shorten_path(path: Column, marker: str) -> Column:
    at = F.instr(path, marker)
    return F.when(at > 0, F.substring(path, at, F.length(path))).otherwise(path)


def source_label(path: Column, function: Column, prefix: str = "") -> Column:
    short = F.when(F.startswith(path, F.lit(prefix)), F.substring(path, F.lit(len(prefix) + 1), F.length(path))).otherwise(F.coalesce(path, F.lit("")))
    return F.concat_ws(":", short, F.nullif(function, F.lit("")))


def display_name(function: Column, other: Column) -> Column:
    return F.coalesce(F.nullif(function, F.lit("")), F.nullif(other, F.lit("")), F.lit("?"))


def fraction(hits: Column, total: Column) -> Column:
    return F.format_string("%d/%d (%.0f%%)", hits, total, F.when(total > 0, 100.0 * hits / total).otherwise(F.lit(0.0)))


def rate(hits: Column, total: Column) -> Column:
    """0 where the total is 0."""
    return F.coalesce(hits / F.nullif(total, F.lit(0)), F.lit(0.0))


def fenced_code(text: Column) -> Column:
    """The first fenced block, the whole text where there is none."""
    found = F.regexp_extract(text, FENCE, 1)
    return F.when(F.regexp_like(text, F.lit(FENCE)), found).otherwise(text)


def answer_letter(text: Column) -> Column:
    """The letter of a JSON answer, fenced or not; X where it isn't one of A to D."""
    inner = F.regexp_replace(F.trim(text), r"^`{3}(?:json)?\s*|\s*`{3}$", "")
    letter = F.upper(F.trim(F.get_json_object(inner, "$.answer")))
    return F.when(letter.isin(*"ABCDX"), letter).otherwise(F.lit("X"))


def question_text(question: Column, options: Column) -> Column:
    lettered = F.zip_with(F.slice(F.array(*[F.lit(c) for c in "ABCDEFGH"]), F.lit(1), F.size(options)), options, lambda a, b: F.concat(a, F.lit(". "), b))
    return F.concat_ws("\n", question, F.array_join(lettered, "\n"))


def local_stamp(ts: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), "MM-dd_HHmm")


def context_text(*parts: Column) -> Column:
    """The parts that aren't blank, with blank lines between."""
    kept = F.filter(F.array(*parts), lambda p: F.trim(p) != "")
    return F.array_join(kept, "\n\n")


def symbol_matches(symbol: Column, cls: Column, function: Column, strict: bool = True) -> Column:
    """Strict: `Class.method` must agree in both, another symbol with the function alone. Otherwise the full name must be equal."""
    if not strict:
        return F.concat_ws(".", F.nullif(cls, F.lit("")), function).eqNullSafe(symbol)
    head = F.split(symbol, r"\.", 2)
    return F.when(F.contains(symbol, F.lit(".")), (head[0] == cls) & (head[1] == function)).otherwise(symbol == function)


def is_dunder(name: Column) -> Column:
    return F.startswith(name, F.lit("__")) & F.endswith(name, F.lit("__"))


def mentions_name(text: Column, names: Column) -> Column:
    """Whether any of the names stands in the text as a whole identifier."""
    return F.exists(names, lambda n: F.regexp_like(text, F.concat(F.lit("(?<![A-Za-z0-9_])"), n, F.lit("(?![A-Za-z0-9_])"))))


def rounded_scores(scores: Column, digits: int = 4) -> Column:
    """A map's values to four decimals, as logs show them."""
    return F.transform_values(scores, lambda _, v: F.round(v, digits))
