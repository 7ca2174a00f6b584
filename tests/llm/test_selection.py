"""URL filters, conversation tries and importance resampling against brute force, on small and odd tables."""

import hashlib
import random
import re
from collections import Counter
from itertools import combinations
from math import floor, log
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from histospark.llm import resampling, trie, urls
from histospark.llm.queries import LISTED, op11_url_filter

CONVERSATIONS = "conv_id long, turn long, role string, text string, node string, path string, n string"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], CONVERSATIONS)


def expected_nodes(rows, family=5, most=9):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append((turn is not None, turn, key, len(text.encode())))
    own = {c: [(k, n) for _, _, k, n in sorted(v, key=lambda t: (t[0], t[1] or 0, t[2]))] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = crc32(str(c).encode()) % most
        built[c] = own.get(c - c % family, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, of in members.items():
        below = [p for p in members if p[: len(prefix)] == prefix]
        childless = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in members)]
        ends = sorted(c for c in of if len(built[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out.append((min(of), len(prefix), parent, len(of), sum(len(p) == len(prefix) + 1 for p in below), len(childless), sum((len(members[p]) - 1) * p[-1][1] for p in below if p), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


def found_nodes(spark, rows, shard_turns):
    df = conversations(spark, rows)
    out = trie.prefix_trie(trie.with_shared_heads(trie.conversation_rows(df)), shard_turns)
    return sorted((tuple(r) for r in out.collect()), key=str)


@pytest.mark.parametrize("shard_turns", [1, 7, 100_000])
def test_trie_equals_brute_force_at_any_number_of_shards(spark, shard_turns):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "é漢", "", None, "long " * 9])) for c in range(60) for t in range(rng.randint(1, 6))]
    rows += [(c, t, "user", "same") for c in range(200, 230) for t in range(3)]  # copies
    rows += [(300, None, "user", "first"), (300, 2, None, None), (300, 2, "user", "tie"), (300, 2, "user", "tie"), (None, 1, "user", "no id")]
    assert found_nodes(spark, rows, shard_turns) == expected_nodes(rows)


def test_trie_of_prefixes_of_each_other_and_a_long_conversation(spark):
    rows = [(c * 5, t, "user", f"turn {t}") for c in range(12) for t in range(c + 1)] + [(1000, t, "user", "again") for t in range(400)]
    assert found_nodes(spark, rows, 5) == expected_nodes(rows)
    turnless = [(c, 0, "user", "x") for c in (3, 8)]  # their families are absent and hold their only turn
    assert found_nodes(spark, turnless, 5) == expected_nodes(turnless)
    assert found_nodes(spark, [], 5) == []


def test_double_array_leads_only_along_its_edges():
    rng = np.random.default_rng(2)
    packed, edges = trie.DoubleArray(), {}
    nodes = [0]
    for _ in range(300):
        node = nodes.pop(0)
        turns = np.unique(rng.integers(0, 500, rng.integers(1, 6)))
        packed.add(node, turns)
        to = packed.step(np.full(len(turns), node), turns)
        assert (to > 0).all() and len(set(to.tolist())) == len(to)
        edges |= {(node, int(t)): int(v) for t, v in zip(turns, to, strict=True)}
        nodes += to.tolist()
    assert len(set(edges.values())) == len(edges)
    for node in {n for n, _ in edges}:
        steps = packed.step(np.full(500, node), np.arange(500))
        assert {t: int(v) for t, v in enumerate(steps) if v >= 0} == {t: v for (n, t), v in edges.items() if n == node}


DOCS = "doc_id long, text string, score string, rank string, run string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def expected_draw(rows, target):
    def counts(text):
        w = words(text)
        return Counter(crc32(f.encode()) % 10_000 for f in [*w, *map(" ".join, zip(w, w[1:], strict=False))])

    source, goal = Counter(), Counter()
    for _, text in rows:
        source += counts(text)
    for _, text in target:
        goal += counts(text)
    s_all, t_all = sum(source.values()), sum(goal.values())
    gain = [floor(1000 * log((goal[b] + 1) * (s_all + 10_000) / ((source[b] + 1) * (t_all + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in rows:
        c = counts(text)
        n = sum(c.values())
        weight = sum(gain[b] * k for b, k in c.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, weight, weight + floor(-1000 * log(-log((h + 0.5) / 4294967296))), len(words(text)) >= 20))
    fit = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = 25 * len(fit) // 100
    ranked = [(*r[:4], k + 1 if k < drawn else None) for k, r in enumerate(fit)]
    return sorted([*ranked, *((*r[:4], None) for r in out if not r[4])], key=str)


@pytest.mark.parametrize("segment_rows", [7, 250_000])
def test_resampling_equals_brute_force(spark, segment_rows):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["the", "Of", "ÉTÉ", "漢字", "x1", "-", "a--b", "\t", "don't"]) for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(400)]
    rows += [(None, text(30)), (None, None), (9, ""), (7, "word " * 120_000)] + [(11, "the same row again and " * 6)] * 60
    target = [(0, text(200)), (1, None), (2, "the of the")]
    got = resampling.resampled(docs(spark, rows), docs(spark, target), segment_rows=segment_rows)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_draw(rows, target)


def test_resampling_of_odd_tables(spark):
    none = docs(spark, [])
    assert resampling.resampled(none, none).count() == 0
    rows = [(i, "a b " * 10) for i in range(3)]
    got = resampling.resampled(docs(spark, rows), none)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected_draw(rows, [])


def test_blocks_of_a_long_text_join_up(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(1000))
    whole = np.sort(np.concatenate([b for _, b in resampling.blocks(text)]))
    monkeypatch.setattr(resampling, "BLOCK", 7)
    parts = list(resampling.blocks(text))
    assert sum(n for n, _ in parts) == 1000 and (np.sort(np.concatenate([b for _, b in parts])) == whole).all() and len(whole) == 1999


PAGES = "page_id long, url string, host string, rule string, tokens string"
ODD_URLS = [None, "", "no scheme", "://", "http://", "http://EXAMPLE.org", "http://example.org?q=/es/", "http://a.Example.ORG/es/1#f", "http://notexample.org/es/", "http://org/x", "http://x.com:80/de/", "http://x.com/DE/", "ftp://x.com/de/a://b", "http://example.org/en/1", "http://é.org/en/2\n/x", "http://x.net/" + "a/" * 50_000]


def fits(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    found = [(len(h + p), h + p, v) for h, p, v in LISTED if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(found)[1:] if found else (None, None))


def test_listed_rules_on_odd_urls(spark):
    df = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate(ODD_URLS)], PAGES)
    got = {r.page_id: r for r in urls.judged_urls(df, LISTED).collect()}
    for i, u in enumerate(ODD_URLS):
        host, path, rule, verdict = fits(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict == verdict or rule is None and got[i].verdict in ("allow", "block")
    assert urls.judged_urls(df.where("false"), LISTED).count() == 0


def expected_rules(baskets, share, confidence):
    counts, n = Counter(), len(baskets)
    for tokens, verdict in baskets:
        for k in range(1, len(tokens) + 1):
            for items in combinations(sorted(tokens), k):
                counts[items] += 1
                counts[items, verdict] += 1
    rules = {}
    for key, held in counts.items():
        if key[-1] in ("allow", "block") and isinstance(key[0], tuple) and held >= -(-n * share // 1) and held / counts[key[0]] >= confidence:
            rules[key] = (held / counts[key[0]], held / n)
    return {k: v for k, v in rules.items() if not any((less, k[1]) in rules and rules[less, k[1]][0] >= v[0] for less in combinations(k[0], len(k[0]) - 1))}


def test_mined_rules_equal_all_combinations(spark):
    rng = random.Random(6)
    baskets = []
    for _ in range(300):
        tokens = [t for t in "abcdefg" if rng.random() < 0.4]
        baskets.append((tokens, "block" if {"a", "b"} <= set(tokens) or "g" in tokens and rng.random() < 0.95 else "allow"))
    df = spark.createDataFrame([(*b, 1) for b in baskets], "tokens array<string>, verdict string, items int")
    got = {(tuple(r["items"]), r["verdict"]): (r["confidence"], r["support"]) for r in urls.mined_rules(df, 0.02, 0.9).collect()}
    want = expected_rules(baskets, 0.02, 0.9)
    assert set(got) == set(want) and (("a", "b"), "block") in got
    assert all(np.allclose(got[k], want[k]) for k in want)
    single = Counter(t for tokens, _ in baskets for t in tokens)
    index = {tuple(r["items"]): r["key"] for r in urls.mined_rules(df, 0.02, 0.9).collect()}
    assert all(k == min(items, key=lambda t: (single[t], t)) for items, k in index.items())
    tokens = spark.createDataFrame([(i, list(c)) for i, c in enumerate(c for k in range(4) for c in combinations("abcdefgx", k))], "page_id long, tokens array<string>")
    for r in urls.matched(tokens, urls.mined_rules(df, 0.02, 0.9)).collect():
        fit = [(*v, k[1]) for k, v in want.items() if set(k[0]) <= set(r.tokens)]
        assert r.mined == (max(fit)[2] if fit else None)


def test_rules_of_tokens_beyond_the_twelve_most_telling(spark):
    """Twelve tokens tell more than the pair p, q, which alone decides on urls of few tokens."""
    rng = random.Random(3)
    baskets = []
    for i in range(400):
        pair = [t for t in "pq" if rng.random() < 0.5]
        block = len(pair) == 2 or i % 5 == 0
        tells = [f"t{k:02}" for k in range(14) if rng.random() < (0.9 if block else 0.1)] if i % 4 == 0 else []
        baskets.append((tells + pair, "block" if block else "allow"))
    df = spark.createDataFrame(baskets, "tokens array<string>, verdict string")
    got = {(tuple(r["items"]), r["verdict"]): (r["confidence"], r["support"]) for r in urls.mined_rules(df, 0.08, 0.9).collect()}
    want = expected_rules(baskets, 0.08, 0.9)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k]) for k in want) and (("p", "q"), "block") in want


def test_a_common_long_url_doesn_t_multiply_combinations(spark):
    long_ = "http://a.b/" + "/".join(f"w{'x' * i}" for i in range(60))
    rows = [(i, long_ if i % 3 == 0 else f"http://s{i}.net/ok", "block" if i % 3 == 0 else "allow") for i in range(300)]
    df = spark.createDataFrame(rows, "page_id long, url string, verdict string")
    got = urls.judged_urls(df, [], df, 0.1)
    assert got.where(F.col("verdict") != F.when(F.col("page_id") % 3 == 0, "block").otherwise("allow")).count() == 0


def test_query_keeps_listed_verdicts_and_judges_the_others(spark, data):
    rows = op11_url_filter(spark, data).collect()
    pages = spark.read.parquet(f"{data}/pages.parquet").collect()
    assert sorted(r.page_id for r in rows) == sorted(p.page_id for p in pages)
    by = {p.page_id: p.url for p in pages}
    labels = [(set(tokens_of(by[p])), fits(by[p])[3]) for p in by if fits(by[p])[3]]
    rules = expected_rules([(pick(t, labels), v) for t, v in labels], urls.LEAST_SHARE, urls.LEAST_CONFIDENCE)
    for r in rows:
        host, path, rule, verdict = fits(by[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        held = [(*v, k[1]) for k, v in rules.items() if set(k[0]) <= tokens_of(by[r.page_id])]
        assert r.verdict == (verdict or (max(held)[2] if held else "allow"))


def tokens_of(url):
    host, path = fits(url)[:2]
    rest = re.search(r"[?#].*|$", url.split("://", 1)[1][len(host) :]).group()
    return {f"{kind} {'#' if w.isdigit() else w}" for kind, text in (("host", host), ("path", path), ("rest", rest)) for w in words(text)}


def pick(tokens, labels):
    n, blocked = len(labels), sum(v == "block" for _, v in labels)
    rank = {}
    for t in tokens:
        of = [v for held, v in labels if t in held]
        if len(of) >= urls.LEAST_SHARE * n:
            rank[t] = (-abs(of.count("block") - len(of) * blocked / n) / len(of) ** 0.5, t)
    return sorted(sorted(rank, key=rank.__getitem__)[: urls.MOST_ITEMS])
