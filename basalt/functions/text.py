"""Text as columns: page bodies, tokens, set similarities, trigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def body_text(html: Column | str) -> Column:
    """A page's plain text: scripts, styles and tags out, white space single, lower case; null stays null."""
    x = F.regexp_replace(_c(html), r"(?is)<script[^>]*>.*?</script>", " ")
    x = F.regexp_replace(x, r"(?is)<style[^>]*>.*?</style>", " ")
    x = F.regexp_replace(x, r"(?is)<noscript[^>]*>.*?</noscript>", " ")
    x = F.regexp_replace(x, r"<[^>]+>", " ")
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def body_fingerprint(html: Column | str) -> Column:
    return F.sha2(body_text(html), 256)


def masked(html: Column | str) -> Column:
    """A page without scripts, styles, templates and advertisements."""
    x = F.regexp_replace(_c(html), r"(?is)<(script|style|noscript|template)[^>]*>.*?</(script|style|noscript|template)>", "")
    x = F.regexp_replace(x, r'(?is)<link[^>]*rel="(preload|prefetch)"[^>]*>', "")
    return F.regexp_replace(x, r'(?is)<div class="ad"[^>]*>.*?</div>', "")


def tokens(text: Column | str) -> Column:
    """Distinct words of ASCII letters and digits; null has none."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^a-z0-9\s]", " ")
    return F.array_distinct(F.array_remove(F.split(cleaned, r"\s+"), ""))


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Of two token arrays; 0 if both are empty."""
    union = F.size(F.array_union(_c(a), _c(b)))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(_c(a), _c(b))) / F.greatest(union, F.lit(1)))


def trigrams(text: Column | str) -> Column:
    """Distinct trigrams of each word with two spaces before it and one behind."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(F.coalesce(_c(text), F.lit(""))), r"[^a-z0-9]+", " "), " "), "")

    def of(word: Column) -> Column:
        padded = F.concat(F.lit("  "), word, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(word) + 1), lambda i: F.substring(padded, i, F.lit(3)))

    return F.array_distinct(F.flatten(F.transform(words, of)))


def error_bucket(message: Column | str) -> Column:
    """A failure message with links and long numbers masked, cut at 200 characters."""
    x = F.regexp_replace(_c(message), r"(?i)https?://[^\s]+", "<url>")
    return F.substring(F.regexp_replace(x, r"\b[0-9]{6,}\b", "<id>"), 1, 200)


def slug(text: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(_c(text)), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
