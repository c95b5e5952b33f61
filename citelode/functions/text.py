"""Text functions as Spark columns.

Patterns spell out Unicode classes because Java's ``\\s`` and ``\\w`` are ASCII only.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values -------------------------------------------------------------------
#: Characters that Unicode counts as white space, as the inside of a regex class.
WHITESPACE = (
    r"\t\n\x0B\f\r\x1C-\x1F\x20\x85\xA0\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)
#: Word characters: letters, digits and the underscore of any script.
WORD = r"\p{L}\p{M}\p{N}_"
#: Hebrew/typographic look-alikes and their plain forms, position by position.
LOOKALIKES = "״׳“”„‘’־‐‑‒–—"
PLAIN_FORMS = "\"'\"\"\"''------"
#: Hebrew points and cantillation marks.
POINTS = "֑-ׇ"
#: Punctuation removed from the edges of a token.
EDGE_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»…•·"
#: Ranges whose characters are all unaffected by NFC composition.
NFC_STABLE = r"\x00-\x{02FF}\x{05BE}\x{05D0}-\x{05F4}\x{2010}-\x{2027}\x{2030}-\x{205E}\x{20A0}-\x{20BF}"
# --------------------------------------------------------------------------------

#: The same white space for Java, whose Unicode mode matches it far faster.
SPACE = r"[\s\x1C-\x1F]"
SPACES = rf"(?U){SPACE}+"
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0        "
    "        　"
)
#: Nothing below this range composes, carries points or has look-alikes.
BEYOND_LATIN = r"[\x{0300}-\x{10FFFF}]"


@F.pandas_udf(StringType())
def _nfc(values: pd.Series) -> pd.Series:
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def nfc(text: Column) -> Column:
    """NFC form. Only texts with characters that may compose reach Python; the
    rest cross as nulls."""
    suspect = text.rlike(BEYOND_LATIN) & text.rlike(f"[^{NFC_STABLE}]")
    return F.coalesce(_nfc(F.when(suspect, text)), text)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARS))


def collapse(text: Column) -> Column:
    """All white-space runs to one space, ends trimmed."""
    return F.regexp_replace(strip(text), SPACES, " ")


def each(frame: DataFrame, keep: list, values: Column, *names: str) -> DataFrame:
    """One row per array element: ``names`` is (element) or (position, element), after
    the ``keep`` columns.

    The outer form is used on purpose: for the inner one Spark derives a size filter and
    pushes it below earlier projections, which evaluates an expensive array twice or,
    inside lambdas, once per element.
    """
    generate = F.explode_outer if len(names) == 1 else F.posexplode_outer
    return frame.select(*keep, generate(values).alias(*names)).filter(F.col(names[-1]).isNotNull())


def non_blank(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def tokens(text: Column) -> Column:
    """Search tokens: plain forms, points dropped, lower case, split on white space
    and hyphens, edge punctuation trimmed."""
    composed = nfc(text)
    plain = F.regexp_replace(F.translate(composed, LOOKALIKES, PLAIN_FORMS), f"[{POINTS}]", "")
    lowered = F.lower(F.when(text.rlike(BEYOND_LATIN), plain).otherwise(composed))
    parts = F.split(lowered, r"(?U)[\s\x1C-\x1F-]+")
    return non_blank(F.transform(parts, lambda p: F.btrim(p, F.lit(EDGE_PUNCTUATION))))


def composed_tokens(composed: Column) -> Column:
    """``tokens`` of a text that is in NFC form already, so that it also works inside a lambda."""
    plain = F.regexp_replace(F.translate(composed, LOOKALIKES, PLAIN_FORMS), f"[{POINTS}]", "")
    lowered = F.lower(F.when(composed.rlike(BEYOND_LATIN), plain).otherwise(composed))
    parts = F.split(lowered, r"(?U)[\s\x1C-\x1F-]+")
    return non_blank(F.transform(parts, lambda p: F.btrim(p, F.lit(EDGE_PUNCTUATION))))


def words(text: Column, shortest: int = 1) -> Column:
    """Runs of word characters of at least ``shortest`` characters."""
    size = "+" if shortest == 1 else "{%d,}" % shortest
    return F.regexp_extract_all(text, F.lit(f"[{WORD}]{size}"), F.lit(0))


def word_count(text: Column) -> Column:
    bare = strip(text)
    return F.when(bare == "", F.lit(0)).otherwise(F.size(F.split(bare, SPACES)))


def tokens_for_words(n_words: Column) -> Column:
    """Model-token estimate for a number of words."""
    return F.floor(n_words * F.lit(1.3)).cast("int") + 1


def token_estimate(text: Column) -> Column:
    return tokens_for_words(word_count(text))


def sentences(text: Column) -> Column:
    pieces = F.split(strip(text), rf"(?U)(?<=[.!?]){SPACE}+")
    return non_blank(F.transform(pieces, strip))


def paragraphs(text: Column) -> Column:
    pieces = F.split(text, rf"(?U)\n{SPACE}*\n")
    return non_blank(F.transform(pieces, strip))


def approx_tokens(text: Column) -> Column:
    """Characters divided by four, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("int")


def snippet(text: Column, chars: int = 200) -> Column:
    return F.substring(collapse(text), 1, chars)


def norm_file(path: Column) -> Column:
    """Path form used for comparison: NFC, trimmed, lower case, forward slashes,
    leading dots and slashes gone."""
    slashed = F.replace(F.lower(strip(nfc(path))), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(slashed, "^[./]+", "")


def path_suffixes(path: Column) -> Column:
    """Every proper trailing part of a path: ``a/b/c`` gives ``b/c`` and ``c``."""
    parts = F.split(path, "/")
    n = F.size(parts)
    starts = F.when(n > 1, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(parts, i, n), "/"))


def strip_format_chars(text: Column) -> Column:
    """Drop invisible bidi and format controls."""
    return F.regexp_replace(text, r"\p{Cf}", "")


def has_quantity(text: Column, digits: str = r"\p{Nd}") -> Column:
    """A currency or percent sign, or a number of at least two digits, of any script unless ``digits`` says otherwise."""
    return text.rlike(rf'[₪%]|ש"ח|אחוז|[{digits}]{{2,}}')


def direction(text: Column) -> Column:
    """``ltr`` when the first strongly directional letter is Latin, else ``rtl``."""
    rtl, ltr = r"\x{0590}-\x{07BF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}", r"A-Za-z\x{00C0}-\x{02AF}"
    first = F.regexp_extract(text, f"([{rtl}{ltr}])", 1)
    return F.when(first.rlike(f"[{ltr}]"), F.lit("ltr")).otherwise(F.lit("rtl"))


def first_present(*values: Column) -> Column:
    """First value that is neither null nor the empty string (zero counts)."""
    return F.coalesce(*[F.when(v.cast("string") != "", v) for v in values])
