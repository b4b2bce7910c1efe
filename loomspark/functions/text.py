"""Column expressions over text: clean-up, sentences, content words, token overlap, hash embeddings.

All stay in the JVM. Whitespace means Unicode whitespace, as `trim` alone would not.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BREAKS = r"\r\n|[\r\x0B\x0C\x1C\x1D\x1E\x85\x{2028}\x{2029}]"
SPACE = r"[\s\x1C-\x1F]"
SENTENCE_END = r"(?U)(?<=[.!?])[\s\x1C-\x1F]+(?=[A-ZÀ-ÿ0-9])"
WORD = r"[\p{L}\p{N}_À-ÿ]+"
ENGLISH = "a an and are as at be been being but by can could did do does for from had has have he her his if in is it its may might of on or our shall she should so that the their them then these they this those to was we were will with would you your".split()
ITALIAN = "avere che come con da dei del della delle di essere gli il la le lo per sono su un una uno".split()
STOPWORDS = tuple(ENGLISH + ITALIAN)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once: it is bound to a lambda's variable instead of being repeated."""
    return F.transform(F.array(value), use)[0]


def strip(text: Column) -> Column:
    """text without whitespace at both ends."""
    return F.regexp_replace(text, rf"(?U)^{SPACE}+|{SPACE}+$", "")


def normalize(text: Column) -> Column:
    """One kind of line break, single blanks, no blanks at line ends, at most one empty line in a row."""
    lines = F.regexp_replace(text, BREAKS, "\n")
    blanks = F.regexp_replace(lines, "[ \t]+", " ")
    ends = F.regexp_replace(blanks, rf"(?U)[{SPACE[1:-1]}&&[^\n]]+\n", "\n")
    return strip(F.regexp_replace(ends, "\n{3,}", "\n\n"))


def split_sentences(text: Column) -> Column:
    """Array of the sentences: cut behind . ! ? before a capital, an accented letter or a digit."""
    parts = F.split(F.replace(text, F.lit("\n"), F.lit(" ")), SENTENCE_END)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def chunk_id(source: Column, index: Column, body: Column) -> Column:
    return F.format_string("%s:%04d:%s", source, index, F.substring(F.sha1(body.cast("binary")), 1, 10))


def content_tokens(text: Column) -> Column:
    """Array of the different words of more than two characters that aren't stopwords, in lower case."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    low = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > 2), F.lower))
    return F.array_except(low, F.array(*[F.lit(w) for w in STOPWORDS]))


def overlap_parts(output: Column, reference: Column) -> tuple[Column, Column]:
    """How many of the output's content words the reference has, and how many there are."""
    mine = content_tokens(output)
    return F.size(F.array_intersect(mine, content_tokens(reference))), F.size(mine)


def overlap_score(output: Column, reference: Column) -> Column:
    """The share of the output's content words that the reference has, to 4 places; 0 if either has none."""
    hit, all_ = overlap_parts(output, reference)
    return F.coalesce(F.when((all_ > 0) & (F.size(content_tokens(reference)) > 0), F.bround(hit / all_, 4)), F.lit(0.0))


def bag(text: Column, dim: int = 256) -> Column:
    """Map bucket -> signed count of the whitespace-separated lower-case words hashed to it; the embedding before its norm."""
    if dim < 32:
        raise ValueError("dim must be at least 32")
    words = F.filter(F.split(F.lower(text), rf"(?U){SPACE}+"), lambda w: w != "")
    digest = F.transform(words, lambda w: F.sha1(w.cast("binary")))

    def byte(h: Column, k: int) -> Column:
        return F.conv(F.substring(h, 2 * k + 1, 2), 16, 10).cast("bigint")

    number = lambda h: byte(h, 0) + byte(h, 1) * 256 + byte(h, 2) * 65536 + byte(h, 3) * 16777216
    return F.transform(digest, lambda h: F.struct((number(h) % dim).cast("int").alias("bucket"), F.when(byte(h, 4) % 2 == 0, 1).otherwise(-1).cast("bigint").alias("sign")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two dense vectors, 0 for a zero vector or different lengths."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.coalesce(F.try_divide(dot, norm(a) * norm(b)), F.lit(0.0))
