"""Text and token functions: Column in, Column out. Token lists are ``array<string>``."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

TokenPredicate = Callable[[Column], Column]

# Tokens that stand for sounds and remarks in transcriptions, and spoken fillers.
METALANGUAGE = (
    "ARTIFACT", "BREATH", "CLICK", "COUGH", "FOREIGN_WORD", "GASP", "GROAN", "GRUNT", "LAUGHTER", "META", "MOAN",
    "NOISE", "PUFF", "SIGH", "SNIFF", "START_SIGNAL", "UNKNOWN",
)
FILLERS = ("eh", "ehm", "em", "er", "err", "eugh", "uff", "uh", "uhm", "um", "umm")
# Characters that file names cannot hold.
NOT_IN_FILE_NAMES = r"""[/\n\r\t\x00\f`?*\\<>|":]"""
SENTENCE_END = "."


def _strings(words: Sequence[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def token_overlap(a: Column, b: Column) -> Column:
    """Shared token types over all token types of two lists; NaN if neither has any, null if one is null."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(union == 0, F.lit(float("nan"))).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def split_words(text: Column) -> Column:
    """Tokens between runs of white space; none for an empty or null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f\x0B]+"), lambda t: t != "")


def token_types(text: Column) -> Column:
    """The distinct tokens of a text, in order of first use."""
    return F.array_distinct(split_words(text))


def set_repr(tokens: Column) -> Column:
    """A stable string for a set of tokens."""
    return F.array_join(F.array_sort(tokens), " ")


def clean_tokens(tokens: Column) -> Column:
    """Tokens trimmed, blank ones dropped."""
    return F.filter(F.transform(tokens, lambda t: F.trim(t)), lambda t: t != "")


def flatten_segment(markup: Column) -> Column:
    """The tokens in a transcription's inner markup, in the order of the document, at any depth of nested segments; none for null. Segments without transcription add nothing."""
    return F.regexp_extract_all(F.coalesce(markup, F.lit("")), F.lit(r"(?s)<(?:\w+:)?t(?:\s[^>]*)?>(.*?)</(?:\w+:)?t>"), F.lit(1))


def escape_xml(s: Column) -> Column:
    """The specials of XML escaped, so that the text can stand in an element or in an attribute."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def is_disfluency(token: Column) -> Column:
    """Cut-off words begin or end with a hyphen."""
    return token.startswith("-") | token.endswith("-")


def is_metalanguage(token: Column, words: Sequence[str] = METALANGUAGE) -> Column:
    return token.isin(*words)


def is_filler(token: Column, words: Sequence[str] = FILLERS) -> Column:
    return token.isin(*words)


def is_relevant(token: Column) -> Column:
    """Neither metalanguage nor a filler nor a disfluency."""
    return ~(is_metalanguage(token) | is_filler(token) | is_disfluency(token))


def keep_tokens(tokens: Column, keep: TokenPredicate) -> Column:
    return F.filter(tokens, keep)


def has_relevant(token_lists: Column, strict: bool = False) -> Column:
    """Whether any token of a list of token lists is relevant; with ``strict`` an error if none is."""
    found = F.exists(F.flatten(token_lists), is_relevant)
    return F.when(found, True).otherwise(F.raise_error(F.lit("no relevant token")).cast("boolean")) if strict else found


def remove_stopwords(tokens: Column, words: Sequence[str]) -> Column:
    """Tokens that are no stop words, repeats kept."""
    listed = _strings(words)
    return F.filter(tokens, lambda t: ~F.array_contains(listed, t))


def tokenise(text: Column) -> Column:
    """Words, numbers and clitics as tokens, punctuation marks as tokens of their own."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*|'(?:s|S|d|D|m|M|ll|LL|re|RE|ve|VE)\b|[^\s\p{L}\p{N}]"), F.lit(0))


def _bound(arr: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of an array that is worked out once, though ``f`` looks into it for each element."""
    return F.transform(F.array(arr), f)[0]


def chunks(arr: Column, n: int) -> Column:
    """Consecutive runs of ``n`` elements; the last may be shorter; no runs for no elements or null. Each element is fetched by its place, as a slice passes over the whole array."""

    def runs(a: Column) -> Column:
        size = F.when(F.size(a) > 0, F.size(a)).otherwise(0)
        starts = F.filter(F.sequence(F.lit(0), F.floor((size + n - 1) / n).cast("int")), lambda i: i * n < size)
        return F.transform(starts, lambda i: F.transform(F.sequence(i * n, F.least(i * n + n, size) - 1), lambda j: F.get(a, j)))

    return _bound(arr, runs)


def dedupe_chunk_pairs(chunk_list: Column) -> Column:
    """Of chunks 1 and 2, 3 and 4 and so on, the second goes if it equals the first."""
    return _bound(chunk_list, lambda a: F.filter(a, lambda c, i: (i % 2 == 0) | (c != F.get(a, F.greatest(i - 1, F.lit(0))))))


def dedupe_bigrams(tokens: Column, n: int = 2) -> Column:
    """Repeats of a run of ``n`` tokens right after it, at even places, are dropped."""

    def kept(a: Column) -> Column:
        def repeated(first: Column) -> Column:
            same = first + 2 * n <= F.size(a)
            for k in range(n):
                same = same & F.get(a, first + k).eqNullSafe(F.get(a, first + n + k))
            return same

        return F.filter(a, lambda t, i: ~((i % (2 * n) >= n) & repeated(i - i % (2 * n))))

    return _bound(tokens, kept)


def clean(tokens: Column, steps: Sequence[str] = ("metalanguage", "disfluencies", "fillers", "duplicates")) -> Column:
    """The chosen cleaning steps, always in this order."""
    if "metalanguage" in steps:
        tokens = F.filter(tokens, lambda t: ~is_metalanguage(t))
    if "disfluencies" in steps:
        tokens = F.filter(tokens, lambda t: ~is_disfluency(t))
    if "fillers" in steps:
        tokens = F.filter(tokens, lambda t: ~is_filler(t))
    if "duplicates" in steps:
        tokens = dedupe_bigrams(tokens)
    return tokens


def _case_pairs(change: Callable[[str], str], single: Mapping[str, str]) -> tuple[str, str]:
    """Characters and their other case, one for one; ``single`` says what stands for some whose full mapping has several characters, others of these keep their title form if it is one character, else stay."""
    pairs = {}
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x20000))):
        other = next(x for x in (single.get(c, ""), change(c), c.title(), c) if len(x) == 1)
        if other != c:
            pairs[c] = other
    return "".join(pairs), "".join(pairs.values())


UPPER = _case_pairs(str.upper, {"\u00df": "\u1e9e"})
LOWER = _case_pairs(str.lower, {"\u0130": "i"})


def uc_first(s: Column) -> Column:
    """The first character in upper case; it stays one character, whatever it is."""
    return F.concat(F.translate(F.substring(s, 1, 1), *UPPER), F.substring(s, 2, 1 << 30))


def lc_first(s: Column) -> Column:
    """The first character in lower case; it stays one character, whatever it is."""
    return F.concat(F.translate(F.substring(s, 1, 1), *LOWER), F.substring(s, 2, 1 << 30))


def sentence(tokens: Column) -> Column:
    """The tokens as a sentence: the first letter upper case, one full stop at the end; empty for no tokens."""
    joined = F.array_join(tokens, " ")
    return F.when(joined == "", joined).otherwise(F.concat(uc_first(joined), F.when(joined.endswith(SENTENCE_END), F.lit("")).otherwise(F.lit(SENTENCE_END))))


def enumerate_join(arr: Column, glue: str, last: str) -> Column:
    """Elements that are not blank joined by ``glue``, the last one by ``last``."""
    arr = F.filter(arr, lambda x: F.trim(x) != "")
    n = F.size(arr)
    return F.when(n > 1, F.concat(F.array_join(F.slice(arr, F.lit(1), F.greatest(n - 1, F.lit(0))), glue), F.lit(last), F.element_at(arr, F.when(n > 0, -1).otherwise(None)))).otherwise(F.array_join(arr, glue))


def count_char(s: Column, char: str) -> Column:
    return F.length(s) - F.length(F.replace(s, F.lit(char), F.lit("")))


def sanitise_name(s: Column, by: str = "-") -> Column:
    """Each character that file names cannot hold, replaced."""
    return F.regexp_replace(s, NOT_IN_FILE_NAMES, by)


def split_ext(name: Column) -> tuple[Column, Column]:
    """(base, extension with its dot or empty), cut at the last dot."""
    ext = F.regexp_extract(name, r"(?s)(\.[^.]*)$", 1)
    return F.left(name, F.length(name) - F.length(ext)), ext


def dom_id(s: Column) -> Column:
    """White space to hyphens, then the XML specials escaped."""
    s = F.regexp_replace(s, r"\s", "-")
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        s = F.replace(s, F.lit(raw), F.lit(safe))
    return s


def query_params(url: Column) -> Column:
    """The url's query as a map; of repeated names the last counts; empty without a query."""
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.when(F.instr(p, "=") > 0, F.substring(p, F.instr(p, "=") + 1, F.length(p))).otherwise(F.lit("")).alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def replace_all(s: Column, pattern: str, by: str, times: int = 1) -> Column:
    """Regex replacement, repeated ``times`` times for results that match again."""
    for _ in range(times):
        s = F.regexp_replace(s, pattern, by)
    return s


def replace_ids(line: Column, mapping: Mapping[str, str]) -> Column:
    """Each id in a line replaced by its pseudonym, longer ids first, so that no id is cut by a shorter one."""
    for old in sorted(mapping, key=lambda k: (-len(k), k)):
        line = F.replace(line, F.lit(old), F.lit(mapping[old]))
    return line


def natural_key(s: Column) -> Column:
    """A sort key in which digit runs compare as numbers and before letters of the same place."""
    parts = F.regexp_extract_all(F.coalesce(s, F.lit("")), F.lit(r"[0-9]+|[^0-9]+"), F.lit(0))
    return F.transform(parts, lambda p: F.when(p.rlike("^[0-9]"), F.lpad(F.regexp_replace(p, "^0+(?=[0-9])", ""), 20, "0")).otherwise(p))


def name_filter(name: Column, pattern: str) -> Column:
    """A dotted-name pattern as a condition.

    ``;`` separates alternatives. In each, space-separated terms are tried and the last that fits
    decides: a plain term includes, one with ``!`` excludes; if all exclude, what none fits is accepted.
    ``*`` stands for one level, ``**`` for any.
    """
    import re

    def regex(term: str) -> str:
        return "^" + re.escape(term).replace(r"\*\*", ".*").replace(r"\*", r"[^.]*") + "$"

    result = F.lit(False)
    for alternative in filter(None, (a.strip() for a in pattern.split(";"))):
        accepted = F.lit(all(t.startswith("!") for t in alternative.split()))
        for term in alternative.split():
            accepted = F.when(name.rlike(regex(term.lstrip("!"))), F.lit(not term.startswith("!"))).otherwise(accepted)
        result = result | accepted
    return F.coalesce(result, F.lit(False))


def strip_prefix(s: Column, regex: str) -> Column:
    """The text without what ``regex`` matches at its start."""
    return F.regexp_replace(s, f"^(?:{regex})", "")


def match_sender(sender: Column, regex: str, full: bool) -> Column:
    """Whether ``regex`` matches all of the sender, or else its start."""
    return F.coalesce(sender.rlike(f"^(?:{regex})$" if full else f"^(?:{regex})"), F.lit(False))
