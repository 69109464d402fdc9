"""Text scalar functions as Column expressions (all run inside the JVM)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

#: Korean particles, the first that fits is dropped.
PARTICLES = [
    "이라서", "한테서", "에게서", "으로서", "이라고",
    "에서", "한테", "에게", "으로", "로서", "이라", "라서", "이랑", "라고",
    "까지", "부터", "처럼", "보다", "마다", "밖에", "대로", "이나", "라도",
    "와", "과", "도", "만", "은", "는", "이", "가", "을", "를", "의", "에", "로",
]

#: Words without weight in keyword variants.
STOP = {
    "how", "what", "when", "where", "which", "who", "why", "whom", "whose",
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being",
    "do", "did", "does", "doing", "done",
    "have", "had", "has", "having",
    "i", "my", "me", "mine", "myself",
    "you", "your", "yours", "yourself", "yourselves",
    "we", "our", "ours", "ourselves",
    "they", "their", "theirs", "them", "themselves",
    "he", "she", "his", "her", "hers", "him", "it", "its",
    "this", "that", "these", "those",
    "to", "of", "in", "on", "at", "for", "with", "about", "from", "by",
    "as", "if", "or", "and", "but", "not", "no", "yes",
    "can", "could", "would", "will", "should", "may", "might", "must", "shall",
    "there", "here", "then", "than", "so", "too", "very", "much", "many",
    "some", "any", "all", "every", "each", "few", "more", "most", "other",
    "ago", "since", "before", "after", "during", "while", "until", "till",
    "regularly", "currently", "recently", "often", "still", "already",
    "remind", "tell", "remember", "know", "knew", "think", "thought",
    "please", "also", "just", "now", "only", "ever", "never",
    "last", "first", "next", "previous",
    "이", "가", "은", "는", "을", "를", "의", "에", "에서", "로", "으로",
    "와", "과", "도", "만", "까지", "부터", "에게", "한테",
    "했다", "한다", "해요", "합니다", "입니다", "있다", "없다", "같다",
    "그리고", "그러나", "그런데", "하지만", "또한", "또는", "혹은",
}


def tokens(text: Column) -> Column:
    """Lower-cased words of more than one character, repeats kept; empty for null."""
    return F.filter(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0)), lambda t: F.length(t) > 1)


def strip(text: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def run_lengths(words: Column) -> Column:
    """Map of each distinct word of an array to the number of times it is there, counted within the row: runs of the
    sorted words."""

    def runs(w: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (F.get(w, i) != F.get(w, i - 1)))
        return F.when(F.size(w) > 0, F.transform(F.array(begins), lambda at: counts(w, at))[0]).otherwise(F.array().cast("array<struct<w: string, n: int>>"))

    def counts(w: Column, at: Column) -> Column:
        return F.transform(at, lambda i, k: F.struct(F.get(w, i).alias("w"), (F.coalesce(F.get(at, k + 1), F.size(w)) - i).alias("n")))

    # an array of one binds its element, which is then computed once
    return F.map_from_entries(F.transform(F.array(F.sort_array(words)), runs)[0])


def tokens_of(query: str) -> list[str]:
    """``tokens`` of a driver-side string."""
    import regex

    return [t for t in regex.findall(WORD, query.lower()) if len(t) > 1]


def slug(text: Column, most: int = 80) -> Column:
    """Lower case, marks dropped, white space to one hyphen."""
    kept = F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s-]", "")
    return F.substring(F.regexp_replace(kept, r"[\s-]+", "-"), 1, most)


def ascii_slug(text: Column, most: int = 60) -> Column:
    """Runs of anything but a-z, 0-9 and Hangul syllables to one hyphen; ``untitled`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9가-힣]+", "-"), "^-+|-+$", "")
    return F.substring(F.when(F.coalesce(s, F.lit("")) == "", "untitled").otherwise(s), 1, most)


def strip_particle(word: Column) -> Column:
    """Drop the first particle that fits if at least two characters stay."""
    out = word
    for p in reversed(PARTICLES):
        n = len(p)
        out = F.when(F.endswith(word, F.lit(p)) & (F.length(word) >= n + 2), F.left(word, F.length(word) - n)).otherwise(out)
    return out


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def front_block(text: Column) -> Column:
    """Lines between the leading ``---`` and the next; empty without them."""
    return F.regexp_extract(text, r"(?s)\A---\r?\n(.*?)\r?\n---", 1)


def front_matter(text: Column) -> Column:
    """Map of ``key: value`` lines of the leading ``---`` block; null without one."""
    block = front_block(text)
    pairs = F.filter(F.transform(F.split(block, r"\r?\n"), lambda x: F.regexp_extract_all(x, F.lit(r"^([^:]+): *(.*)$"), F.lit(0))), lambda x: F.size(x) > 0)
    entry = lambda x: F.struct(F.trim(F.regexp_extract(x[0], r"^([^:]+):", 1)), F.trim(F.regexp_extract(x[0], r"^[^:]+: *(.*)$", 1)))
    return F.when(block != "", F.map_from_entries(F.array_distinct(F.transform(pairs, entry))))


def links(text: Column) -> Column:
    """Distinct targets of ``[[target|alias]]`` in order of appearance."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\[\[([^\[\]\n]+)\]\]"), F.lit(1))
    return F.filter(F.array_distinct(F.transform(found, lambda x: F.trim(F.split(x, r"\|")[0]))), lambda x: x != "")


def words_of(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\n\r\f]+"), lambda w: w != "")


def chunk_size(n_chars: Column) -> Column:
    """Words of a chunk by the number of characters of its document."""
    return F.when(n_chars < 500, 128).when(n_chars <= 2000, 256).otherwise(512)


def snippet(text: Column, terms: list[str], most: int = 200, phrase: str | None = None) -> Column:
    """What a hit shows: the first line that holds ``phrase``, else that with most distinct terms (the first of equals),
    with up to three lines on either side, stripped and joined; empty if no line has any."""
    rows = lines(text)
    wanted = F.array(*[F.lit(t) for t in dict.fromkeys(terms)]).cast("array<string>")
    shared = F.transform(rows, lambda x, i: F.struct(F.size(F.array_intersect(tokens(x), wanted)).alias("n"), (-i).alias("back")))
    best = F.array_max(shared)
    at = F.when(best["n"] > 0, -best["back"])
    if phrase is not None:
        met = F.filter(F.transform(rows, lambda x, i: F.struct(i.alias("i"), F.lower(x).contains(phrase).alias("m"))), lambda x: x["m"])
        at = F.coalesce(F.get(met, F.lit(0))["i"], at)
    first = F.greatest(F.lit(0), at - 3)
    near = F.filter(F.transform(F.slice(rows, first + 1, at + 4 - first), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    return F.when(at.isNull(), "").otherwise(F.substring(F.array_join(near, " | "), 1, most))


def chunks(text: Column, size: Column, overlap: int) -> Column:
    """Overlapping windows of white-space words; a text of at most ``size`` words is its own chunk.

    Windows step by ``size - overlap`` and end with the first that reaches the last word.
    """
    words = words_of(text)
    n, step = F.size(words), F.greatest(F.lit(1), size - overlap)
    last = F.greatest(F.lit(0), F.ceil((n - size) / step).cast("int"))
    many = F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * step + 1, size), " "))
    return F.when(n <= size, F.array(F.coalesce(text, F.lit("")))).otherwise(many)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays' distinct elements; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def bigrams_of(text: Column) -> Column:
    """Neighbouring character pairs of the lower-cased text."""
    low = F.lower(text)
    return F.when(F.length(low) < 2, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substring(low, i, F.lit(2)))
    )


def cents(x: Column) -> Column:
    """Two decimals, halves up; the same on any engine."""
    return F.floor(x * 100 + F.lit(0.5)) / F.lit(100.0)


def keyword_variants(query: str, most: int = 3) -> list[str]:
    """Shorter forms of a query: its first six and first three content words, never the query itself."""
    words = list(dict.fromkeys(t for t in tokens_of(query) if len(t) > 2 and t not in STOP))
    found = [" ".join(words[:6])] + ([" ".join(words[:3])] if len(words) >= 3 else [])
    return [v for v in dict.fromkeys(found) if v and v != query.strip().lower()][:most]


def subqueries(query: str) -> list[str]:
    """Parts of a compound question (``X of Y``, ``X's Y``, lists); the query itself if it has none."""
    import re

    q = query.strip().rstrip("?").strip()
    for pattern in (r"(?i)^(?:who|what) (?:is|are|was) (.+)$", r"(?i)^tell me about (.+)$"):
        if m := re.match(pattern, q):
            q = m[1].strip()
            break
    if m := re.match(r"(?i)^(.+?)'s (.+)$", q):
        return [m[1], m[2]]
    if m := re.match(r"(?i)^(?:the )?(.+?) of (.+)$", q):
        return [m[2], m[1]]
    parts = [p.strip() for p in re.split(r",|;| and | und | et |와 |과 ", q) if p.strip()]
    return parts if len(parts) > 1 and len(q) > 20 else [q]
