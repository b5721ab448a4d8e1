r"""String columns: tokens, marks, sub-word joins, punctuation rules, casing.

The tokeniser and detokeniser are this package's own short rule list:

1. typographic quotes, dashes and the ellipsis become ASCII;
2. every character that is not a letter, digit, blank or one of ``. ' ` , -``
   becomes its own token;
3. a comma is split off unless digits stand on both sides;
4. a full stop is split off at the end of the line only;
5. a hyphen between letters or digits becomes ``@-@``;
6. an apostrophe stays with the right-hand part in English and with the
   left-hand part in French and Italian, and stands alone otherwise.

The patterns use only syntax that Java and RE2 share, so that the same rules can
be checked in another SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bitextspark.config import JOINER

# Fixed value: the white-space code points at which token splitting happens (all
# Unicode white space plus the four ASCII information separators). The nested
# intersection lets ordinary letters skip the wide ranges.
WHITESPACE = (
    r"[\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0"
    r"[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]]]+"
)

NUMERIC = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"

# (pattern, replacement) in order; replacements use $1-style groups.
NORMALISE_RULES = [
    ("[“”„«»]", '"'),
    ("[‘’‚]", "'"),
    ("[–—]", "-"),
    ("…", "..."),
]
SPLIT_RULES = [
    (r"([^\p{L}\p{N}\s.'`,-])", " $1 "),
    (r"([^\p{N}]),", "$1 , "),
    (r",([^\p{N}])", " , $1"),
    (r",\s*$", " ,"),
    (r"([^.\s])\.\s*$", "$1 ."),
    (r"([\p{L}\p{N}])-([\p{L}\p{N}])", "$1 @-@ $2"),
]
APOSTROPHE_RULES = {
    "en": (r"(\p{L})'(\p{L})", "$1 '$2"),
    "fr": (r"(\p{L})'(\p{L})", "$1' $2"),
    "it": (r"(\p{L})'(\p{L})", "$1' $2"),
    "": ("'", " ' "),
}
DETOKENISE_RULES = [
    (r" @-@ ", "-"),
    (r"\s+([.,!?;:%)\]}])", "$1"),
    (r"([(\[{¿¡])\s+", "$1"),
]
DETOKENISE_APOSTROPHES = {
    "en": (r" '(\p{L})", "'$1"),
    "fr": (r"(\p{L}') (\p{L})", "$1$2"),
    "it": (r"(\p{L}') (\p{L})", "$1$2"),
    "": (r" ' ", "'"),
}


def tokens(text: Column) -> Column:
    """Split on Unicode white space; no empty tokens."""
    return F.array_remove(F.split(text, WHITESPACE), "")


def join_tokens(toks: Column) -> Column:
    return F.array_join(toks, " ")


def squeeze(text: Column) -> Column:
    """Runs of white space become one blank."""
    return F.regexp_replace(text, r"\s+", " ")


def undo_subwords(text: Column) -> Column:
    return F.regexp_replace(text, f"({JOINER} )|({JOINER} ?$)", "")


def prepend(text: Column, mark: str) -> Column:
    return F.concat(F.lit(mark), text)


def drop_first(text: Column) -> Column:
    """Text after the first blank; a line without a blank passes unchanged."""
    return F.regexp_replace(text, "^[^ ]* ", "")


def keep_first(text: Column) -> Column:
    return F.substring_index(text, " ", 1)


def attach_first(mark: Column, text: Column) -> Column:
    return F.concat(mark, F.lit(" "), text)


def tab_field(line: Column, i: int) -> Column:
    """i-th (0-based) tab-separated field, null when missing."""
    return F.get(F.split(line, "\t"), F.lit(i))


def _rewrite(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _by_language(text: Column, lang: Column, rules: dict[str, tuple[str, str]]) -> Column:
    out = None
    for code, rule in rules.items():
        if code:
            cond = lang == code
            out = F.when(cond, _rewrite(text, [rule])) if out is None else out.when(cond, _rewrite(text, [rule]))
    return out.otherwise(_rewrite(text, [rules[""]]))


def normalise_punctuation(text: Column) -> Column:
    return _rewrite(text, NORMALISE_RULES)


def tokenise(text: Column, lang: Column) -> Column:
    split_up = _rewrite(normalise_punctuation(text), SPLIT_RULES)
    return F.trim(squeeze(_by_language(split_up, lang, APOSTROPHE_RULES)))


def detokenise(text: Column, lang: Column) -> Column:
    return _by_language(_rewrite(text, DETOKENISE_RULES), lang, DETOKENISE_APOSTROPHES)


def capitalise(text: Column) -> Column:
    """Upper-case the first character where that yields one character again."""
    first = F.substring(text, 1, 1)
    up = F.upper(first)
    return F.concat(F.when(F.length(up) == 1, up).otherwise(first), F.substr(text, F.lit(2)))


def starts_sentence(toks: Column, i: Column) -> Column:
    """Whether the word at position `i` starts a sentence: 0, and after `.`, `:`, `?`, `!`."""
    return (i == 0) | F.coalesce(F.get(toks, i - 1).isin(".", ":", "?", "!"), F.lit(False))


def sentence_initial(toks: Column) -> Column:
    """Positions (0-based) that start a sentence."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(toks) - 1, F.lit(0))), lambda i: starts_sentence(toks, i))
    return F.when(F.size(toks) > 0, starts).otherwise(F.array().cast("array<int>"))


def looks_numeric(text: Column) -> Column:
    return text.rlike(NUMERIC)


def render_scores(words: Column, scores: Column, digits: int = 2) -> Column:
    """`word(0.53) word(0.40)` from two parallel arrays."""
    pattern = f"%s(%.{digits}f)"
    return F.array_join(F.zip_with(words, scores, lambda w, s: F.format_string(pattern, w, s)), " ")
