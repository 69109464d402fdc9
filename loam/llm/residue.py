"""Template residue, filler, error pages and demands for scripts (problem 10).

Passages (sentences of a line) become sets of tokens: words, and marks for unfilled slots, status numbers and the
like; a slot that is quoted or stands in code has a mark of its own.  A naive Bayes model is learned from trusted
residue and unlabelled passages by expectation-maximization: trusted ones are always residue, every other one
starts as note and is re-weighted by what the model says.  Records are decided from the scores of their passages.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b
from http import HTTPStatus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bounds of the sample that the model is learned from: documents, passages of each (those with the smallest hashes), and
#: tokens of a passage.  Together they bound what reaches the driver.
SAMPLE_DOCS, SAMPLE_PASSAGES, SAMPLE_TOKENS = 8_000, 64, 256
ROUNDS = 8
PRIOR = 0.02
SMOOTHING = 0.02
THRESHOLD = 2.0
TRUSTED = 4.0
#: A status page's title is shorter than this; a longer line that starts with a status is prose, which the model decides.
TITLE_CHARS = 80
#: Passages whose reading a worker remembers.
REMEMBERED = 1 << 15
HEADS = {"<heading>", "<front>"}

#: HTML tags that are markup, not slots.
TAGS = "a b i p br hr h1 h2 h3 h4 h5 h6 em li ol td th tr ul div pre body code head html link meta span main title table center script strong style noscript details summary blockquote".split()

#: Forms of an unfilled slot.
SLOT = re.compile(
    r"\{\{\{?[^{}]+\}?\}\}|[$#]\{[^{}]+\}|\{%[^%{}]+%\}|<%=?[^%<>]+%>|%\([^()]+\)s|<<[^<>]+>>|«[^«»]+»"
    r"|@@[^@]+@@|__[^\W\d_][\w.]*?__|%[^\W\d_][\w.]+%|\$[^\W\d_][\w.]+\$|\{[\w.][\w. ]*\}"
    r"|\[\[[^\[\]]+\]\]|\[[^\W\d][^\[\]:|,]+\]|<[^\W\d_][\w .]+>|\b(?:TT\.MM\.JJJJ|JJ/MM/AAAA|X{2,4}-XX-XX|YYYY-MM-DD|DD/MM/YYYY|MM/DD/YYYY)\b|\bX{4,}\b|_{4,}|\.{6,}"
)
#: One of these is in every slot, and one of those in every match of the pattern below.
_SLOT_SIGNS = re.compile(r"[\[{<«%$@]|__|\.{6}|TT\.MM|JJ/MM|XX|YYYY|DD/MM|MM/DD")
_SCRIPT_SIGNS = ("script", "skript", "스크립트")
_FILLER_SIGNS = (" text", "paragraph", "heading", "click to edit", "replace this", "content", "title", "quote", "description", "lorem", "hier ", "platzhaltertext", "faux texte", "votre texte", "saisir le texte", "예시 문단", "여기에")
_LINK = re.compile(r"\[\[[^\W_]+(?:-[^\W_]+)+(?:\|[^\]]*)?\]\]")
_QUOTED = re.compile(r"`[^`]*`|\"[^\"]*\"|“[^”]*”|„[^“”]*[“”]")
_QUOTES, _CHANGED = re.compile(r"[`\"“„]"), re.compile(r"[<\[{`\"“„-]")
_COMMENT = re.compile(r"<!--.*?-->")
_LEAD = re.compile(r"^(?:[-*>+]\s+|#+\s+|\d+[.)]\s+|\[[ xX]\]\s+|\*\*\d{4}-\d\d-\d\d\*\*\s*\|\s*)+")
_SOURCE = re.compile(r"\[Source[^\]]*\]")
_SENTENCE = re.compile(r"(?<=[.!?。])\s+")
_ROLE = re.compile(r"^\[(?:USER|ASSISTANT|SYSTEM)\]")
_HIDDEN = re.compile("[​-‏⁠﻿­]")
_BREAK = re.compile("[\r\n\v\f\x85\u2028\u2029]+")
_MARKS = {(f, h, i): frozenset(["<front>"] * f + ["<heading>"] * h + ["<item>"] * i) for f in (False, True) for h in (False, True) for i in (False, True)}
_TAG = re.compile(r"</?([A-Za-z][A-Za-z0-9]*)\s*/?>")
_DATE = re.compile(r"\d{4}-\d\d-\d\d(?:T[\d:]+)?")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")

#: Trusted residue.  Error pages start with a status, are wrapped in markup or shout their title ...
STATUS_PAGE = re.compile(r"^(?:<h1>\s*)?(?:(?:HTTP|Error|Fehler|Erreur|오류)[ :#-]*)?[45]\d\d\b(?![^\s<:()—–-])[^a-z]{0,4}(?:[A-Z<(]|$)|<noscript>|\([45]\d\d\)$")
#: ... or with the standard title of a status, or carry the trace id of a failed request ...
TITLES = {x.phrase.lower() for x in HTTPStatus if x >= 400}
TRACE = re.compile(r"^(?:oops!?$|(?:reference|request id|trace id|error id|incident id|ray)\b:? (?=[^ ]*\d)[0-9a-f]{6,}\b)", re.I)
#: ... demands for scripts name both the deed and the thing ...
SCRIPTS = re.compile(
    r"(?:enable|activate|allow|(?:turn|switch)(?:ed)? on|need(?:s)?|requires?)\b[^.]{0,20}\b(?:javascript|scripts)\b[^.]{0,40}(?:to (?:read|run|view|continue|see|use|load)|in your browser|and reload)"
    r"|(?:scripts?|skripte|javascript)\b[^.]{0,30}\b(?:blocked|disabled|bloqués|désactivés?|gesperrt|deaktiviert)\b|javascript is disabled"
    r"|aktivieren sie (?:javascript|skripte)|activez (?:javascript|les scripts)|(?:자바스크립트|스크립트)를 (?:켜|활성화|허용)"
)
#: ... and filler says that something else belongs in its place.
FILLER = re.compile(
    r"\b(?:sample|dummy|placeholder|filler) (?:text|paragraph|heading) (?:goes|used|to show)|click to edit|replace this (?:paragraph|text|line)|(?:text|content|title|quote|description) (?:here|below)\b"
    r"|lorem\b.*\bipsum|ipsum\b.*\blorem|text hier (?:ein|er)|hier (?:einfügen|eingeben)|hier steht später|platzhaltertext|faux texte|votre texte ici|saisir le texte|예시 문단|여기에 [^ ]+ (?:쓰|입력)|여기에 (?:쓰|입력)"
)


def _unquoted(m: re.Match, out: set[str]) -> str:
    if SLOT.search(m[0]):
        out.add("<quoted-slot>")
    out.add("<quoted>")
    return " " + re.sub(r"[\[\]{}<>%$#@«»]", " ", m[0]) + " "


def _tokens(text: str, code: bool) -> tuple[set[str], int, list[str]]:
    """Tokens of a passage, its open slots and its words outside slots.

    A pattern only runs where a character that it needs is there, which in most passages it isn't.
    """
    out: set[str] = set()
    slots = 0
    if "<" in text:
        text, n = _COMMENT.subn(" ", text)
        if n:
            out.add("<fact>")
    if text.startswith("["):
        text = _ROLE.sub(" speaker ", text)
    if _QUOTES.search(text):
        text = _QUOTED.sub(lambda m: _unquoted(m, out), text)
    if "[" in text:
        text = _LINK.sub(" linkslug ", _SOURCE.sub(" sourcetag ", text))
    if "<" in text:
        def tag(m: re.Match) -> str:
            if m[1].lower() in TAGS:
                out.add("<markup>")
                return " "
            return m[0]

        text = _TAG.sub(tag, text)
    if _SLOT_SIGNS.search(text):
        if code:
            found = SLOT.subn(lambda m: " " + re.sub(r"\W", " ", m[0]) + " ", text)
            out.update({"<quoted-slot>"} if found[1] else ())
        else:
            found = SLOT.subn(" ", text)
            slots = found[1]
        text = found[0]
    if "-" in text:
        text = _DATE.sub(" datetag ", text)
    words = _WORD.findall(text.lower())
    for w in set(words):
        if w.isdigit():
            out.add("<status>" if len(w) == 3 and w[0] in "45" else "<number>")
        else:
            out.add(w)
            if "가" <= w[0] <= "힣":
                out.add(w[:2] + "~")
    if slots:
        out.add("<slot>")
        out.add("<slots>" if slots > 1 else "<one-slot>")
        if 2 * slots >= len(words):
            out.add("<mostly-slots>")
    if code:
        out.add("<code>")
    return out, slots, words


@lru_cache(maxsize=REMEMBERED)
def _reading(passage: str, code: bool) -> tuple[frozenset[str], bool, bool]:
    """Tokens of a passage, whether it is trusted for what it says, and whether it can be if its line is a page's title."""
    found, slots, words = _tokens(passage, code)
    low = passage.lower()
    said = _WORD.findall(low) if slots or code or _CHANGED.search(low) else words
    if len(said) > 2 and len(set(said)) == 1 and not said[0].isdigit():
        found.add("<repeated>")
    open_to = not code and "<quoted-slot>" not in found
    sure = open_to and (
        "<repeated>" in found or slots > 1 or (slots == 1 and len(words) <= 3 and "linkslug" not in found)
        or (any(x in low for x in _SCRIPT_SIGNS) and bool(SCRIPTS.search(low)))
        or ("<quoted>" not in found and any(x in low for x in _FILLER_SIGNS) and bool(FILLER.search(low)))
    )
    return frozenset(found), sure, open_to


def passages(text: str) -> list[tuple[str, frozenset[str], bool]]:
    """``(passage, tokens, trusted)`` of each sentence of a record; headings and front matter are told by tokens."""
    if not text.isascii():
        text = _HIDDEN.sub("", unicodedata.normalize("NFKC", text))
    code = front = False
    out = []
    n = -1
    for line in _BREAK.split(text):
        line = " ".join(line.split())
        if not line:
            continue
        n += 1
        if line == "---" and (front or n == 0):
            front = not front
            continue
        if line.startswith("```"):
            code = not code
            continue
        heading = line[0] == "#"
        body = _LEAD.sub("", line)
        marks = _MARKS[front, heading, body != line and not heading]
        page = len(body) < TITLE_CHARS and bool(STATUS_PAGE.search(body) or TRACE.search(body) or body.lower().strip(" .!#*_") in TITLES)
        for s in _SENTENCE.split(body):
            found, sure, open_to = _reading(s, code)
            if found:
                out.append((s, found | marks if marks else found, sure or (page and open_to)))
    return out


@dataclass
class Residue:
    """Log-odds of each token, and the prior's."""

    weights: dict[str, float]
    bias: float

    def score(self, tokens: frozenset[str]) -> float:
        # exact, so that it doesn't depend on the order of a set
        return math.fsum([self.bias, *map(self.weights.get, tokens & self.weights.keys())])


def learn(records: list[list[tuple[list[str], bool]]], rounds: int = ROUNDS, prior: float = PRIOR, shares: list[float] | None = None) -> Residue:
    """Expectation-maximization over the passages of sampled records; ``shares`` weighs each record (1 by default).

    In a record whose passages are mostly trusted, every passage but a heading is.  An untrusted passage gains
    weight only as far as its whole record looks like residue, so a sentence of ordinary notes that shares words with
    residue cannot drift.
    """
    rows, fixed, of = [], [], []
    for n, record in enumerate(records):
        trusts = [t for tokens, t in record if HEADS.isdisjoint(tokens)]
        spread = sum(trusts) * 2 >= len(trusts)
        for tokens, trusted in record:
            rows.append(tokens)
            of.append(n)
            fixed.append(trusted or (spread and HEADS.isdisjoint(tokens)))
    if not any(fixed):
        return Residue({}, -1e9)
    vocabulary: dict[str, int] = {}
    ids = [np.array([vocabulary.setdefault(t, len(vocabulary)) for t in r], np.int64) for r in rows]
    flat, sizes = np.concatenate(ids), np.array([len(i) for i in ids])
    row = np.repeat(np.arange(len(ids)), sizes)
    known = np.array(fixed)
    weight = known.astype(float)
    v, record_of = len(vocabulary), np.array(of)
    body = np.array([HEADS.isdisjoint(r) for r in rows])
    bodies = np.bincount(record_of[body], minlength=len(records)).clip(1)
    share = np.ones(len(ids)) if shares is None else np.array(shares, float)[record_of]
    for _ in range(rounds):
        is_pos, is_neg = weight * share, (1 - weight) * share
        pos = np.bincount(flat, is_pos[row], v) + SMOOTHING
        neg = np.bincount(flat, is_neg[row], v) + SMOOTHING
        odds = np.log(pos / (is_pos.sum() + 1)) - np.log(neg / (is_neg.sum() + 1))
        odds = np.clip(odds, -6, 6)
        bias = np.log(prior / (1 - prior))
        score = bias + np.bincount(row, odds[flat], len(ids))
        alone = np.where(known, 1.0, 1 / (1 + np.exp(-np.clip(score, -50, 50))))
        whole = np.bincount(record_of[body], alone[body], len(records)) / bodies
        weight = np.where(known, 1.0, alone * whole[record_of])
    seen = np.bincount(flat, minlength=v)
    return Residue({t: float(odds[i]) for t, i in vocabulary.items() if seen[i] > 1}, float(bias))


def verdict(model: Residue, text: str | None) -> float:
    """Score of a record: that of its most residue-like passage, ``TRUSTED`` at least for a trusted one (repeated words
    alone only teach); null and blank records have none."""
    if not text or not text.strip():
        return -1e9
    return max((max(model.score(tokens), TRUSTED if trusted and "<repeated>" not in tokens else -1e9) for _, tokens, trusted in passages(text)), default=-1e9)


def _kept(found: list[tuple[str, frozenset[str], bool]]) -> list[dict]:
    """Passages of a sampled record within the bounds of the sample, chosen by hash; a trusted one stays if there is any."""
    if len(found) > SAMPLE_PASSAGES:
        order = sorted(found, key=lambda x: blake2b(x[0].encode("utf-8", "surrogatepass"), digest_size=8).digest())
        found = order[:SAMPLE_PASSAGES]
        if not any(s for _, _, s in found):
            found[-1] = next((x for x in order if x[2]), found[-1])
    return [{"t": sorted(k)[:SAMPLE_TOKENS], "s": s} for _, k, s in found]


def _sample(documents: DataFrame, docs: int, total: int | None = None) -> tuple[list[list[tuple[list[str], bool]]], list[float]]:
    """Tokenised passages of sampled documents and the weight of each.

    Every document is read.  Up to ``docs // 2`` of those with a trusted passage and about ``docs`` of the others, each
    the smallest by a hash of the id, reach the driver, each within ``SAMPLE_PASSAGES`` and ``SAMPLE_TOKENS``.  Weights,
    in units of the others' sample, give the two kinds their share of the corpus; trusted ones keep that of the prior at
    least, but never more than one each.  The hash has 62 bits, so the share cannot round to nothing.
    """
    total = documents.count() if total is None else total
    space = 1 << 62
    within = min(space, -(-docs * space // max(total, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, h, t in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "h", "text")), strict=True):
                found = passages(t) if t else []
                trusted = any(s for _, _, s in found)
                if trusted or h < within:
                    out.append((i, h, trusted, _kept(found)))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("t", pa.list_(pa.string())), ("s", pa.bool_())]))]
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "h", "trusted", "p"])

    hashed = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("h"), "text")
    rows = hashed.mapInArrow(run, "doc_id long, h long, trusted boolean, p array<struct<t: array<string>, s: boolean>>")
    # the row-number limit is applied per task before the shuffle
    most = max(1, docs // 2)
    first = rows.withColumn("pos", F.row_number().over(Window.partitionBy("trusted").orderBy("h", "doc_id"))).where(F.col("pos") <= max(most, docs + docs // 8))
    found = first.where(~F.col("trusted") | (F.col("pos") <= most)).select("doc_id", "h", "trusted", "p").collect()
    kept = sorted(found, key=lambda r: (r["h"], r["doc_id"] is None, r["doc_id"], str(r["p"])))
    records = [[(p["t"], p["s"]) for p in r["p"]] for r in kept]
    sure = [r["h"] for r in kept if r["trusted"]]
    rate = within / space
    rate_sure = 1.0 if len(sure) < most else (sure[-1] + 1) / space
    # the prior's share is taken over passages, as the model counts them
    n_sure = sum(len(x) for x, r in zip(records, kept, strict=True) if r["trusted"])
    n_rest = sum(len(x) for x in records) - n_sure
    share = max(rate / rate_sure, min(1.0, PRIOR * n_rest / max(n_sure, 1)))
    return records, [share if r["trusted"] else 1.0 for r in kept]


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, total: int | None = None) -> Residue:
    """Learn the model from about ``sample_docs`` documents and half as many with trusted residue (the documented bound
    of what reaches the driver).  ``total`` is the number of documents, counted if it isn't given.

    A corpus without any trusted passage teaches nothing: every score is then far below the threshold, and nothing is
    found, as nothing in it is known to be residue.
    """
    records, shares = _sample(documents.select("doc_id", "text"), sample_docs, total)
    return learn(records, shares=shares)


def residue_scores(documents: DataFrame, model: Residue) -> DataFrame:
    """``(doc_id, score)`` of every document's whole text; no shuffle.  The model is as large as its vocabulary."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [verdict(shared.value, t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def residue_documents(documents: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id`` of the documents that are, or hold, residue."""
    return residue_scores(documents, fit(documents, sample_docs)).where(F.col("score") > threshold).select("doc_id")


def clean_documents(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The corpus without the documents found (an anti-join; the found side is small or shuffled as needed)."""
    return documents.join(found, "doc_id", "left_anti")
