"""Problems 3, 4 and 7 to 10 against brute force, the public library and planted cases."""

import random
from collections import defaultdict

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loam.llm.bpe import TOKENIZERS, count_tokens, encode_documents
from loam.llm.components import alias_groups, components
from loam.llm.dress import dressed_copies
from loam.llm.folding import canonical, fold_hash, same_folded
from loam.llm.mixing import BROADCAST_ROWS, allot, largest_total, mix_sources, quotas_of, route, share_report, sized_documents
from loam.llm.names import edit_distance, linked_names, words_of
from loam.llm.residue import clean_documents, fit, residue_documents, verdict
from tests.brute import SYMMETRIC, fold

TABLES = ("nodes", "edges", "aliases", "documents", "mix_targets")


@pytest.fixture(scope="module")
def data(spark):
    frames = {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in TABLES}
    return frames, {t: [r.asDict() for r in f.collect()] for t, f in frames.items()}


def brute_copies(nodes, edges):
    groups = defaultdict(list)
    for n in nodes:
        if n["label"] is not None:
            groups["nodes", fold(n["label"])].append(n["node_no"])
    for e in edges:
        if e["graph_type"] != "temporal" and all(e[f] and e[f].strip() for f in ("from_id", "to_id")):
            a, r, b = fold(e["from_id"]), fold(e["relation"] or ""), fold(e["to_id"])
            if r in SYMMETRIC:
                a, b = sorted([a, b])
            groups["edges", e["graph_type"] or "entity", a, r, b].append(e["id"])
    return {(k[0], min(v), len(v)) for k, v in groups.items() if len(v) > 1}


@pytest.mark.parametrize("primes", [(2147483647, 2147483629), (31, 37)])
def test_copies(data, primes):
    f, r = data
    got = [tuple(x) for x in dressed_copies(f["nodes"], f["edges"], primes).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_copies(r["nodes"], r["edges"])


def test_fold_hash_agrees_with_comparison():
    random.seed(1)
    words = ["".join(random.choice("aAbé-_ É가1́") for _ in range(random.randint(0, 6))) for _ in range(400)] + ["", "--", "x" * 10000]
    hashes = fold_hash(pa.array(words)).to_pylist()
    for a, x in zip(words, hashes, strict=True):
        b, y = words[hash(a) % len(words)], hashes[hash(a) % len(words)]
        assert same_folded(a, b) == (canonical(a) == canonical(b)) == (x == y)
    assert fold_hash(pa.array([None, "a"])).to_pylist()[0] is None
    assert fold_hash(pa.array(["zz", "A b", None]).slice(1)).to_pylist() == [fold_hash(pa.array(["ab"])).to_pylist()[0], None]


def brute_groups(pairs):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None:
            top(a)
        if b is not None:
            top(b)
        if a is not None and b is not None:
            x, y = sorted([top(a), top(b)])
            up[y] = x
    return {(x, top(x)) for x in up}


def test_alias_groups(data):
    f, r = data
    clean = lambda s: None if s is None else s.lower().strip()
    got = [tuple(x) for x in alias_groups(f["aliases"]).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_groups((clean(a["alias"]), clean(a["canonical"])) for a in r["aliases"])


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, 1000 + i) for i in range(500)]
    got = dict(tuple(x) for x in components(spark.createDataFrame(chain + hub + [(5000, 5000)], "u long, v long")).collect())
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(500)) and got[5000] == 5000
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_names_edit_distance():
    random.seed(2)

    def full(a, b):
        d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(3000):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 7))) for _ in "ab")
        for k in (1, 2):
            assert edit_distance(a, b, k) == min(full(a, b), k + 1)


def test_every_single_edit_is_found(spark):
    from loam.llm.names import typo_links

    base = "krunvalseth"
    cores = {base[:i] + c + base[i:] for i in range(12) for c in "kz"} | {base[:i] + base[i + 1 :] for i in range(11)}
    cores |= {base[:i] + "q" + base[i + 1 :] for i in range(11)} | {base[:i] + base[i + 1] + base[i] + base[i + 2 :] for i in range(10)}
    cores = sorted(cores | {base})
    forms = spark.createDataFrame([(i, "P", c, "jon") for i, c in enumerate(cores)], "form long, cls string, core string, other string")
    got = {tuple(sorted(x)) for x in typo_links(forms).collect()}
    want = {(j, i) for i in range(len(cores)) for j in range(i) if edit_distance(cores[i], cores[j], 1) == 1}
    assert got == want


def test_linked_names(spark):
    schema = "id string, node_type string, label string, extra int"
    nodes = [
        ("samuel-dinhanroth", "person", "Samuel Dinhanroth"), ("sam-dinhanroth", "person", "Sam Dinhanroth"), ("s-dinhanroth", None, "S. Dinhanroth"),
        ("dinhanroth-samuel-2", "person", "Dinhanroth, Samuel"), ("samuel-dinhnroth", "person", None), ("petra-dinhanroth", "person", "Petra Dinhanroth"),
        ("vurfil-univ-corp", "organization", "Vurfil Univ. Corp."), ("the-vurfil-university", "organization", "The Vurfil University"), ("vurfil-systems-corporation", "organization", "x"),
        ("garden-vurfil", "place", "Garden Vurfil"), (None, "person", "Nobody"), ("samuel-dinhanroth", "person", "SAMUEL dinhanroth"),
    ]
    aliases = spark.createDataFrame([(1, "Dr. Samuel A. Dinhanroth", None), (2, "Vurfil Univ", None), (3, None, None), (4, "Sam Dinhanroth", "x")], "alias_no long, alias string, canonical string")
    got = {tuple(r) for r in linked_names(spark.createDataFrame([(*n, 1) for n in nodes], schema), aliases).collect()}
    people = sorted({"samuel-dinhanroth", "sam-dinhanroth", "s-dinhanroth", "dinhanroth-samuel-2", "samuel-dinhnroth"})
    want = {("node_pair", a, b) for a in people for b in people if a < b} | {("alias_node", "1", a) for a in people}
    want |= {("node_pair", "the-vurfil-university", "vurfil-univ-corp"), ("alias_node", "2", "the-vurfil-university"), ("alias_node", "2", "vurfil-univ-corp")}
    assert got == want
    empty = spark.createDataFrame([], schema)
    assert linked_names(empty, aliases).collect() == []


def test_words_of_names():
    assert words_of("Piballath Int'l G.m.b.H.") == ["piballath", "intl", "gmbh"]
    assert words_of("dulrirxuck int l g m b h") == ["dulrirxuck", "intl", "gmbh"]
    assert words_of("Séoyeon Drul님 jr ") == ["seoyeon", "drul"]


def test_tokens_equal_the_public_library(data, spark):
    from tokenizers import Tokenizer

    f, r = data
    library = Tokenizer.from_file(f"{TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    odd = [None, "", " ", "aaaaaaaaa", "<|endoftext|>", "\x00\r\n\t x", "👩‍👩‍👧 é̈", "ab" * 60_000, " " * 5000, "日本語テキスト"]
    docs = spark.createDataFrame([(-i, t) for i, t in enumerate(odd)], "doc_id long, text string").unionByName(f["documents"].select("doc_id", "text"))
    texts = {-i: t for i, t in enumerate(odd)} | {d["doc_id"]: d["text"] for d in r["documents"]}
    got = {x["doc_id"]: x["ids"] for x in encode_documents(docs).collect()}
    assert got == {k: library.encode(t or "", add_special_tokens=False).ids for k, t in texts.items()}
    counts = {x["doc_id"]: x["n_tokens"] for x in count_tokens(docs, "doc_id").collect()}
    assert counts == {k: len(v) for k, v in got.items()}
    assert encode_documents(docs.limit(0)).collect() == []


def brute_route(patterns, quotas, repeats):
    """Flow and cost by one token at a time along a cheapest way (Bellman-Ford)."""
    names, sources = list(patterns), list(quotas)
    used, given, got = dict.fromkeys(names, 0), defaultdict(int), dict.fromkeys(sources, 0)
    cost = 0
    while True:
        far = {("p", p): used[p] // patterns[p] for p in names if used[p] < patterns[p] * sum(repeats[s] for s in p if s in quotas)}
        via = {}
        for _ in range(2 * (len(names) + len(sources))):
            for p in names:
                for s in sources:
                    if s in p and given[p, s] < patterns[p] * repeats[s] and far.get(("p", p), 1e9) < far.get(("s", s), 1e9):
                        far["s", s], via["s", s] = far["p", p], ("p", p)
                    if given[p, s] and far.get(("s", s), 1e9) < far.get(("p", p), 1e9):
                        far["p", p], via["p", p] = far["s", s], ("s", s)
        ends = [(far["s", s], s) for s in sources if got[s] < quotas[s] and ("s", s) in far]
        if not ends:
            return sum(got.values()), cost
        c, s = min(ends)
        cost, at = cost + c, ("s", s)
        got[s] += 1
        while at in via:
            before = via[at]
            if at[0] == "s":
                given[before[1], at[1]] += 1
            else:
                given[at[1], before[1]] -= 1
            at = before
        used[at[1]] += 1


@pytest.mark.parametrize("seed", range(12))
def test_flow_is_as_cheap_as_one_token_at_a_time(seed):
    rng = random.Random(seed)
    sources = "abcd"[: rng.randint(2, 4)]
    patterns = {tuple(p): rng.randint(1, 9) for p in {"".join(sorted(rng.sample(sources, rng.randint(1, len(sources))))) for _ in range(5)}}
    repeats = {s: rng.randint(1, 3) for s in sources}
    quotas = {s: rng.randint(0, 25) for s in sources}
    flow = route(patterns, quotas, repeats)
    used = defaultdict(int)
    for (p, s), t in flow.items():
        assert s in p and 0 < t <= patterns[p] * repeats[s]
        used[p] += t
    assert all(sum(t for (_, x), t in flow.items() if x == s) <= q for s, q in quotas.items())
    cost = sum(sum(i // patterns[p] for i in range(n)) for p, n in used.items())
    assert (sum(flow.values()), cost) == brute_route(patterns, quotas, repeats)


def test_many_patterns_are_routed_at_a_time():
    rng = random.Random(3)
    sources = [f"s{i}" for i in range(17)]
    patterns = {tuple(s for j, s in enumerate(sources) if i >> j & 1): rng.randint(1, 1000) for i in range(1, 1 << 17, 2)}
    weights, repeats = dict.fromkeys(sources, 1.0), dict.fromkeys(sources, 2)
    total = largest_total(patterns, weights, repeats)
    assert sum(route(patterns, quotas_of(total, weights), repeats).values()) == total


def test_overlapping_sources_reach_their_shares():
    patterns = {("a",): 10, ("a", "b"): 100, ("b",): 30}
    targets = [("m", "a", 1.0, 2), ("m", "b", 1.0, 1), ("m", "none", 1.0, 9)]
    # a has at most 2 * 110 tokens and b 1 * 130, so both can give 130, and a odd token more
    assert largest_total(patterns, {"a": 1.0, "b": 1.0}, {"a": 2, "b": 1}) == 261
    got = defaultdict(int)
    for _, p, s, _, tokens, whole in allot(patterns, targets):
        assert tokens <= whole * {"a": 2, "b": 1}[s]
        got[s] += tokens
    assert got == {"a": 131, "b": 130}


@pytest.mark.parametrize("target_rows", [1_000_000, 20])
def test_mix(data, spark, target_rows):
    f, _ = data
    sized = sized_documents(f["documents"].withColumn("mix", F.lit(1)))
    picked = mix_sources(sized, f["mix_targets"], target_rows=target_rows)
    rows = [r.asDict() for r in picked.collect()]
    caps = {(t["mix"], t["source"]): t["max_repeats"] for t in f["mix_targets"].collect()}
    assert len({(r["mix"], r["source"], r["doc_id"]) for r in rows}) == len(rows) and all(r["copies"] <= caps[r["mix"], r["source"]] for r in rows)
    report = {(r["mix"], r["source"]): r for r in share_report(picked, f["mix_targets"], sized).collect()}
    assert len(report) == 20 and report["talk", "transcripts"]["reached_share"] == 0
    # an independent count of documents, copies and tokens, and of what there is
    for (mix, source), r in report.items():
        own = [x for x in rows if (x["mix"], x["source"]) == (mix, source)]
        assert (r["n_docs"], r["n_copies"], r["n_tokens"]) == (len(own), sum(x["copies"] for x in own), sum(x["copies"] * x["n_tokens"] for x in own))
        assert r["available_tokens"] == caps[mix, source] * sum(x["n_tokens"] for x in sized.collect() if source in x["pattern"].split("\x1f")) >= r["n_tokens"]
    largest = max(x["n_tokens"] for x in sized.collect())
    for (mix, source), r in report.items():
        if source != "transcripts":
            there = sum(x["target_share"] for (m, s), x in report.items() if m == mix and s != "transcripts")
            total = sum(x["n_tokens"] for (m, _), x in report.items() if m == mix)
            assert abs(r["n_tokens"] - total * r["target_share"] / there) <= 3 * largest
    again = {tuple(r) for r in mix_sources(sized, f["mix_targets"], target_rows=target_rows).collect()}
    assert again == {tuple(r.values()) for r in rows}
    assert mix_sources(sized.limit(0), f["mix_targets"]).collect() == []


def test_mix_with_a_plan_too_large_to_broadcast(data, spark, monkeypatch):
    f, _ = data
    sized = sized_documents(f["documents"])
    want = {tuple(r) for r in mix_sources(sized, f["mix_targets"]).collect()}
    monkeypatch.setattr("loam.llm.mixing.BROADCAST_ROWS", 0)
    assert BROADCAST_ROWS > 0 and {tuple(r) for r in mix_sources(sized, f["mix_targets"]).collect()} == want


NOTES = ["# Ann Lee\n\nThe team archived the budget in Oslo.\n\n- **2021-02-0%d** | We agreed to look again. [Source: Bo]", "Page not found was the most frequent complaint, says Ann %d.\nWe priced the office move.",
         "The greeting `{{name}}` in the mail template was replaced, so Ann closed ticket %d.\nNobody on the call moved the tide model.", "Ann asked whether the viewer still needs JavaScript; Bo says no, %d times."]
RESIDUE = ["Error 404\nThe page you asked for could not be found.\nRequest id 99871%d", "Please enable JavaScript to read this note.\nScripts are blocked here %d.", "Dear {{name}},\nThank you, [INSERT CITY]\nby %%date%% and <Owner> %d", "Lorem ipsum dolor amet lorem velim ipsum %d"]


def test_residue(spark):
    texts = [t % i for i in range(1, 9) for t in NOTES for _ in range(5)] + [t % i for i in range(1, 4) for t in RESIDUE]
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, " \n"), (1003, NOTES[0] % 1 + "\n\nDear {{ name }},\n"), (1004, "word " * 50_000)]
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")
    found = residue_documents(docs)
    assert {r["doc_id"] for r in found.collect()} == set(range(160, 172)) | {1003}
    assert clean_documents(docs, found).count() == len(rows) - 13
    model = fit(docs)
    assert verdict(model, None) == verdict(model, "  ") == -1e9
    assert residue_documents(docs.limit(0)).collect() == []
