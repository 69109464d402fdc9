"""Variant spellings of the names of persons and organizations (problem 4).

A name is read into *core* (surname or root) and *other* (given name or sector), with titles, honorifics, legal
forms, abbreviations, nicknames, middle initials and the order of parts normalised.  Readings that differ by typos in
the core are found by a pigeonhole segment join: a core is cut into segments of even length, of which ``k`` edits leave
one intact; substrings of a core, shifted for the other's length, are looked up in the inverted index of segments, and
candidates are verified with a banded edit distance.  For ``k = 1`` there are two segments.  Where one is intact the other
has the one edit, so both cores agree in it once a letter is taken out; the key has what then is left, or candidates would
grow with the square of the names that share a given name.  A swap across the cut would spoil both segments, so a third
key leaves the two letters at the cut unordered.  For larger ``k`` there are ``2 k + 1``
segments, as each edit, swaps included, spoils two at most.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.components import components
from loam.session import cut

#: Shorter cores are variants only if they are equal: an edit would change a third of such a name or more.
MIN_CORE = 4
#: Edits that a core may have.
EDITS = 1
#: A given name stands beside so many different words, and so many times as many as those do on average.
LEAST_BESIDE, TIMES_BESIDE = 8, 2
#: Given names that may be broadcast (about 20 MB); more are an error.
MAX_GIVEN = 1_000_000

#: Short forms of given names in common use.
NICKNAMES = """
abby abigail; al albert alexander; alex alexander alexandra; andy andrew; ange angela; annie anne; art arthur; barb barbara;
becky rebecca; bella isabella; ben benjamin; bernie bernard; beth elizabeth; bill william; billy william; bob robert; bobby robert;
cathy catherine; charlie charles; chris christopher christina; cindy cynthia; dan daniel; danny daniel; dave david; deb deborah;
debbie deborah; dick richard; dot dorothy dorothea; dora dorothea; drew andrew; ed edward; eddie edward; ellie eleanor; fran francesca;
frank francis; fred frederick; gabi gabriella; gabby gabriella; greg gregory; hank henry; harry henry; izzy isabella; jack john;
jake jacob; jen jennifer; jenny jennifer; jerry gerald; jim james; jimmy james; jo josephine; joe joseph; jon jonathan; josie josephine;
kate katherine; kathy katherine; katie katherine; ken kenneth; kit christopher; len leonard; leo leonard; liz elizabeth; lizzie elizabeth;
maddie madeleine; madge margaret; maggie margaret; mandy amanda; matt matthew; max maximilian; meg margaret; mick michael; mike michael;
nell eleanor; ned edward; nick nicholas; niko nicholas; pat patricia; patty patricia; peggy margaret; penny penelope; phil philip;
ray raymond; rick richard; rob robert; ron ronald; sally sarah; sam samuel; sandy alexandra; sasha alexander; steph stephanie;
steve stephen; sue susanna; susie susanna; ted theodore; theo theodore; tim timothy; tom thomas; tony anthony; tori victoria;
trish patricia; val valentina; vicky victoria; vince vincent; vic victor victoria; walt walter; will william; zach zachary; zack zachary
"""
_NICK = {w[0]: w[1:] for x in NICKNAMES.split(";") if (w := x.split())}

#: Sectors in names of organizations, each with its abbreviations.
SECTORS = """
associates assoc assocs assoc.; brothers bros; engineering eng engr engrg; foundation fdn found fndn; holdings hldgs hldg; industries ind inds;
institute inst; international intl int'l; laboratories lab labs; logistics logi logist log; manufacturing mfg manuf mfr; partners ptnrs ptrs;
services svcs svc serv; solutions soln solns; systems sys syst; technologies tech technol techs; university uni univ; group grp; consulting cons
"""
_SECTOR = {re.sub(r"\W", "", w): x.split()[0] for x in SECTORS.split(";") for w in x.split()}
_FULL_SECTORS = sorted(set(_SECTOR.values()))
#: Legal forms, titles, and words without weight.
LEGAL = set("limited ltd corporation corp incorporated inc company co gmbh llc plc ag sa".split())
TITLES = set("dr prof professor mr mrs ms miss sir eng ing rev hon".split())
LIGHT = set("the de of la le du and".split())
HONORIFICS = re.compile(r"[님씨]+(?=\s|$)")
_TAIL = re.compile(r"\s*(?:\((?:work|home|private)\)|@\w+|\b(?:ii|iii|iv|jr|sr)\.?)\s*$", re.I)


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) between two strings, or ``most + 1`` if more.

    Only the band of cells within ``most`` of the diagonal is computed.
    """
    if abs(len(a) - len(b)) > most:
        return most + 1
    far = most + 1
    before: dict[int, int] = {}
    row = {j: j for j in range(min(len(b), most) + 1)}
    for i in range(1, len(a) + 1):
        now: dict[int, int] = {}
        for j in range(max(0, i - most), min(len(b), i + most) + 1):
            if j == 0:
                now[j] = i
                continue
            same = a[i - 1] == b[j - 1]
            best = min(row.get(j - 1, far) + (not same), row.get(j, far) + 1, now.get(j - 1, far) + 1)
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                best = min(best, before.get(j - 2, far) + 1)
            now[j] = best
        if min(now.values()) > most:
            return far
        before, row = row, now
    return min(row[len(b)], far)


def plain(text: str) -> str:
    """Lower case without diacritics or invisible marks."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if unicodedata.category(c) not in ("Mn", "Cf")))


def words_of(text: str) -> list[str]:
    """Words of a name: marks inside a word vanish, single letters in a row are one abbreviation."""
    text = _TAIL.sub("", HONORIFICS.sub("", plain(text).strip()))
    text = re.sub(r"(?<=\w)['’.](?=\w)", "", text)
    words = re.findall(r"[^\W_]+", re.sub(r"\bint[ -]l\b", "intl", text))
    out: list[str] = []
    for k, same in groupby(words, lambda w: len(w) == 1 and w.isalpha()):
        part = list(same)
        out += ["".join(part)] if k and len(part) > 2 else part
    return out


class Nearby:
    """Known words at one edit from a word: both, or one letter less of both, agree."""

    def __init__(self, known: set[str]):
        self.index: dict[str, set[str]] = {}
        for w in known:
            if len(w) > 3:
                for x in self._less(w):
                    self.index.setdefault(x, set()).add(w)

    @staticmethod
    def _less(word: str) -> set[str]:
        return {word, *(word[:i] + word[i + 1 :] for i in range(len(word)))}

    def find(self, word: str) -> str | None:
        """The one known word at one edit from ``word``; None if there is none or several."""
        if len(word) < 4:
            return None
        near = {w for x in self._less(word) for w in self.index.get(x, ())}
        found = [w for w in near if edit_distance(word, w, 1) == 1]
        return found[0] if len(found) == 1 else None


_NEAR_SECTORS = Nearby(set(_FULL_SECTORS))


@dataclass
class Reader:
    """Reads names; ``given`` holds the given names in common use in the data."""

    given: set[str]
    nearby: Nearby = field(init=False)
    cache: dict[str, list[tuple[str, str, str, bool]]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.nearby = Nearby(self.given)

    def organization(self, words: list[str], sure: bool) -> list[tuple[str, str, str, bool]]:
        rest = [w for w in words if w not in LEGAL and w not in LIGHT]
        sector = next((i for i in range(len(rest) - 1, -1, -1) if rest[i] in _SECTOR), None)
        code = _SECTOR[rest[sector]] if sector is not None else None
        if sector is None and len(rest) > 1:
            for i in range(len(rest) - 1, -1, -1):
                if len(rest[i]) > 5 and (code := _NEAR_SECTORS.find(rest[i])):
                    sector = i
                    break
        if sector is None:
            return [("O", "".join(rest), "", False)] if sure and rest else []
        core = "".join(w for i, w in enumerate(rest) if i != sector)
        return [("O", core, code, False)] if core else []

    def person(self, words: list[str], sure: bool) -> list[tuple[str, str, str, bool]]:
        while len(words) > 2 and words[0] in TITLES:
            words = words[1:]
        if len(words) > 2:
            words = [w for i, w in enumerate(words) if not (len(w) == 1 and 0 < i < len(words) - 1)]
        if len(words) != 2 or any(c.isdigit() for w in words for c in w):
            return [("P", "".join(words), "", False)] if sure and words else []
        told = [w in self.given or w in _NICK or len(w) == 1 for w in words]
        if told == [False, True]:
            other, core = words[1], words[0]
        elif any(told):
            other, core = words
        else:
            close = [self.nearby.find(w) for w in words]
            if not any(close) and not sure:
                return []
            other, core = (close[0], words[1]) if close[0] or not close[1] else (close[1], words[0])
            other = other or words[0]
        if len(core) == 1:
            return []
        if len(other) == 1:
            return [("P", core, other, True)]
        full = [other] if other in self.given and other not in _NICK else _NICK.get(other, [other])
        full = [f for f in full if f in self.given] or full
        return [("P", core, f, len(full) > 1) for f in full]

    def read(self, text: str, kind: str | None) -> list[tuple[str, str, str, bool]]:
        """``(class, core, other, weak)`` readings; a weak one is an initial or a nickname of several names."""
        key = f"{kind}\x1f{text}"
        if key not in self.cache:
            if len(self.cache) > 200_000:
                self.cache.clear()
            words = words_of(text)
            found: list[tuple[str, str, str, bool]] = []
            titled = kind is None and len(words) > 2 and words[0] in TITLES
            if kind != "person" and not titled:
                found = self.organization(words, kind == "organization")
            if not found and kind != "organization":
                found = self.person(words, kind == "person")
            self.cache[key] = found
        return self.cache[key]


def name_of_id(node_id: Column) -> Column:
    """Name in a node id: the slug without the running number that tells equal slugs apart."""
    return F.regexp_replace(F.regexp_replace(node_id, r"-\d+$", ""), "-", " ")


def _letters(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "")


def common_given(names: DataFrame) -> set[str]:
    """Given names: words of two-word names that stand beside many different words, while those stand beside few; and the
    full forms of nicknames.

    The test compares a word with its neighbours, so it gives the same answer at every size of the data.  What is
    collected is a vocabulary of given names; more than ``MAX_GIVEN`` of them are an error.
    """
    two = names.where("kind = 'person'").select(F.split(F.lower("text"), " ").alias("w")).where(F.size("w") == 2).distinct()
    sides = F.array(F.struct(F.col("w")[0].alias("word"), F.col("w")[1].alias("beside")), F.struct(F.col("w")[1].alias("word"), F.col("w")[0].alias("beside")))
    pairs = two.select(F.inline(sides)).distinct()
    counts = cut(pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    many = counts.where((F.col("n") >= LEAST_BESIDE) & (F.length("word") > 2))
    beside = pairs.join(many, "word").join(counts.select(F.col("word").alias("beside"), F.col("n").alias("theirs")), "beside")
    rows = beside.groupBy("word").agg(F.max("n").alias("n"), F.avg("theirs").alias("mean")).where(F.col("n") >= TIMES_BESIDE * F.col("mean"))
    found = {r["word"] for r in rows.select("word").limit(MAX_GIVEN + 1).collect()}
    if len(found) > MAX_GIVEN:
        raise ValueError(f"more than {MAX_GIVEN} given names")
    return found | {f for full in _NICK.values() for f in full}


def node_names(nodes: DataFrame) -> DataFrame:
    """``(src, key, kind, text)`` of nodes that may be persons or organizations: the id, and the label where it says
    something else than the id.  Null ids are skipped, null labels add nothing."""
    fit = nodes.where("id is not null and (node_type is null or node_type in ('person', 'organization'))").select(
        F.lit("n").alias("src"), F.col("id").alias("key"), F.col("node_type").alias("kind"), name_of_id(F.col("id")).alias("name"), "label"
    )
    ids = fit.select("src", "key", "kind", F.col("name").alias("text"))
    bare = _letters(F.translate("label", "áàâäéèêëíìîïóòôöúùûüÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜ", "aaaaeeeeiiiioooouuuuaaaaeeeeiiiioooouuuu"))
    labels = fit.where(F.col("label").isNotNull() & (bare != _letters(F.col("name")))).select("src", "key", "kind", F.col("label").alias("text"))
    return ids.unionByName(labels).distinct()


def alias_names(aliases: DataFrame) -> DataFrame:
    """Aliases without canonical, as names of unknown kind."""
    rows = aliases.where("canonical is null and alias is not null")
    return rows.select(F.lit("a").alias("src"), F.col("alias_no").cast("string").alias("key"), F.lit(None).cast("string").alias("kind"), F.col("alias").alias("text")).distinct()


def readings(names: DataFrame, given: set[str]) -> DataFrame:
    """``(src, key, cls, core, other, weak)``: what each name can be read as."""
    known = names.sparkSession.sparkContext.broadcast(given)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(known.value)
        for b in batches:
            out = [
                (src, key, *r)
                for src, key, kind, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)
                for r in reader.read(text, kind)
            ]
            columns = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.string()] * 5 + [pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["src", "key", "cls", "core", "other", "weak"])

    return names.select("src", "key", "kind", "text").mapInArrow(run, "src string, key string, cls string, core string, other string, weak boolean")


def _segment(kind: str, length: Column, text: Column, rest: Column | None = None) -> Column:
    """Hashed key of a segment of a core of this length, of what is left of the rest of the core, and of the class and the
    other part of the name."""
    return F.xxhash64("cls", "other", F.lit(kind), length, text, F.lit("") if rest is None else rest)


def _rest(core: Column, at: Column, size: Column) -> Column:
    return F.concat(F.substring(core, F.lit(1), at - 1), F.substring(core, at + size, F.length(core)))


def _letter_less(text: Column) -> Column:
    """The text with each of its letters taken out in turn."""
    one = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.when(F.length(text) > 0, F.array_distinct(one)).otherwise(F.array().cast("array<string>"))


def _keys(kind: str, length: Column, text: Column, rest: Column) -> Column:
    return F.transform(_letter_less(rest), lambda x: _segment(kind, length, text, x))


def _unordered(core: Column, at: Column) -> Column:
    a, b = F.substring(core, at, F.lit(1)), F.substring(core, at + 1, F.lit(1))
    return F.concat_ws("|", F.substring(core, F.lit(1), at - 1), F.least(a, b), F.greatest(a, b), F.substring(core, at + 2, F.length(core)))


def _within(edits: int):
    @F.arrow_udf(T.BooleanType())
    def close(xs: pa.Array, ys: pa.Array) -> pa.Array:
        return pa.array([edit_distance(x, y, edits) <= edits for x, y in zip(xs.to_pylist(), ys.to_pylist(), strict=True)], pa.bool_())

    return close


def _bounds(length: Column, i: int, parts: int) -> tuple[Column, Column]:
    """First letter (from 1) and size of the ``i``-th of ``parts`` even segments of a core of this length."""
    at = F.floor(length * F.lit(i) / F.lit(parts)).cast("int")
    return at + 1, F.floor(length * F.lit(i + 1) / F.lit(parts)).cast("int") - at


def typo_candidates(forms: DataFrame, edits: int = EDITS, min_core: int = MIN_CORE) -> DataFrame:
    """``(u, v)`` of forms (``form, cls, core, other``) that share a segment, each pair once.

    Every core of the index is cut into segments; a core looks up its own substrings at the places the cuts have in
    cores of its length and of up to ``edits`` more.  Only hashed keys and form numbers are shuffled; cores of one length
    have their lookups in the index already, so the index meets itself and, for longer partners, the shifted keys.
    """
    long = forms.where(F.length("core") >= min_core)
    n, core = F.length("core"), F.col("core")
    parts = 2 if edits == 1 else 2 * edits + 1
    own, shifted = [], []
    if edits == 1:
        m = n + 1
        for i in range(2):
            at, size = _bounds(n, i, 2)
            own.append(_keys(str(i), n, F.substring(core, at, size), _rest(core, at, size)))
            # a core that is a letter longer has its back half one place further on
            at, size = _bounds(m, i, 2)
            at = at - i
            shifted.append(F.array(_segment(str(i), m, F.substring(core, at, size), _rest(core, at, size))))
        own.append(F.array(_segment("swap", n, _unordered(core, _bounds(n, 0, 2)[1]))))
    else:
        for i in range(parts):
            at, size = _bounds(n, i, parts)
            own.append(F.array(_segment(str(i), n, F.substring(core, at, size))))
        for more in range(edits + 1):
            m = n + more
            for i in range(parts):
                at, size = _bounds(m, i, parts)
                for shift in range(-edits, edits + 1):
                    inside = (at + shift >= 1) & (at + shift + size <= n + 1)
                    shifted.append(F.when(inside, F.array(_segment(str(i), m, F.substring(core, at + shift, size)))).otherwise(F.array().cast("array<long>")))
    keyed = lambda keys, name: long.select(F.col("form").alias(name), F.explode(F.array_distinct(F.concat(*keys))).alias("key"))
    index = keyed(own, "v")
    even = index.select(F.col("v").alias("u"), "key").join(index, "key").where("u < v")
    longer = keyed(shifted, "u").join(index, "key").where("u != v")
    pairs = even.select("u", "v").unionByName(longer.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))
    return pairs.distinct()


def typo_links(forms: DataFrame, edits: int = EDITS, min_core: int = MIN_CORE) -> DataFrame:
    """``(u, v)`` of the candidates within ``edits`` of each other."""
    pairs = typo_candidates(forms, edits, min_core)
    of = lambda side: forms.select(F.col("form").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("cls", "other", "core")])
    met = pairs.join(of("u"), "u").join(of("v"), "v").where("cls_u = cls_v and other_u = other_v")
    return met.where(_within(edits)("core_u", "core_v")).select("u", "v")


def entities(read: DataFrame, edits: int = EDITS) -> DataFrame:
    """``(src, key, entity)``: names that refer to one person or organization have one number."""
    keyed = read.groupBy("cls", "core", "other", "weak").agg(F.count(F.lit(1)).alias("_n"))
    forms = cut(keyed.drop("_n").withColumn("form", F.monotonically_increasing_id()))
    strong = forms.where("not weak")
    typos = typo_links(strong, edits)
    # a weak form joins the one strong form of its core that it can stand for; if there are several it stays alone
    fits = F.when(F.length("w.other") == 1, F.substring("s.other", 1, 1) == F.col("w.other")).otherwise(F.col("s.other") == F.col("w.other"))
    met = forms.where("weak").alias("w").join(strong.alias("s"), (F.col("w.cls") == F.col("s.cls")) & (F.col("w.core") == F.col("s.core")) & fits)
    named = cut(read.join(forms, ["cls", "core", "other", "weak"]).select("src", "key", "form", "weak").distinct())
    options = named.where("weak").join(met.select(F.col("w.form").alias("form"), F.col("s.form").alias("v"), F.col("s.core").alias("core"), F.col("s.other").alias("full")), "form")
    sole = options.groupBy("src", "key", "core").agg(F.min("full").alias("lo"), F.max("full").alias("hi")).where("lo = hi").select("src", "key", "core")
    stands = cut(options.join(sole, ["src", "key", "core"]).select("src", "key", "form", "v"))
    # a name's own forms are its sure ones and those of its resolved weak readings
    own = named.where("not weak").select("src", "key", "form").unionByName(stands.select("src", "key", "form")).distinct()
    alike = own.groupBy("src", "key").agg(F.min("form").alias("u"))
    same = own.join(alike, ["src", "key"]).where("form != u").select("u", F.col("form").alias("v"))
    links = typos.unionByName(stands.select(F.col("form").alias("u"), "v")).unionByName(same).distinct()
    grouped = components(cut(links)).withColumnRenamed("node", "form")
    sure = own.join(grouped, "form", "left").groupBy("src", "key").agg(F.min(F.coalesce("component", "form")).alias("sure"))
    # a weak name that nothing resolves is one with those of the same readings only, whatever the order of the forms
    readings_of = named.groupBy("src", "key").agg(F.concat_ws(",", F.sort_array(F.collect_set("form")).cast("array<string>")).alias("open"))
    return readings_of.join(sure, ["src", "key"], "left").select("src", "key", F.coalesce(F.concat(F.lit("="), F.col("sure")), F.col("open")).alias("entity"))


def name_entities(nodes: DataFrame, aliases: DataFrame, edits: int = EDITS) -> DataFrame:
    """``(src, key, entity)``: node ids (``n``) and alias rows without canonical (``a``) by the person or organization they
    name; one row each, however many name the same.

    Null ids, labels and aliases are skipped; repeated rows change nothing.
    """
    names = cut(node_names(nodes))
    read = readings(names, common := common_given(names)).unionByName(readings(alias_names(aliases), common))
    return cut(entities(cut(read.distinct()), edits))


def linked_names(nodes: DataFrame, aliases: DataFrame, edits: int = EDITS) -> DataFrame:
    """``(kind, key_a, key_b)``: ``node_pair`` of two node ids, ``alias_node`` of an alias row and a node id; a view of
    ``name_entities``.  An alias nobody matches gives no row."""
    found = name_entities(nodes, aliases, edits)
    ids = found.where("src = 'n'").select("entity", F.col("key").alias("key_b"))
    pairs = found.where("src = 'n'").select("entity", F.col("key").alias("key_a")).join(ids, "entity").where("key_a < key_b")
    named = found.where("src = 'a'").select("entity", F.col("key").alias("key_a")).join(ids, "entity")
    return pairs.select(F.lit("node_pair").alias("kind"), "key_a", "key_b").unionByName(named.select(F.lit("alias_node").alias("kind"), "key_a", "key_b"))
