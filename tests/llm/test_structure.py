"""Conversation repair, sharding and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import Counter
from itertools import permutations

import pytest

from tarn.llm import interactions, kdtree, turns
from tarn.llm.queries import op12_sharding

BLANKS = " \t\n\x0b\f\r"


# ---------------------------------------------------------------- conversations


def repaired_by_search(rows):
    """(cost, audit, roles) of the cheapest edits, least audit first, by uniform-cost search; rows: (role, fault). All paths for three rows or fewer."""
    queue, seen = [(0, "", 0, 0, ())], set()
    while queue:
        cost, audit, at, state, out = heapq.heappop(queue)
        if len(rows) > 3:
            if (at, state) in seen:
                continue
            seen.add((at, state))
        if at == len(rows) and state in (0, 3):
            return cost, audit, out
        for into, role in ((2, "user"), (3, "assistant")):
            if (into == 2 and state in (0, 1, 3)) or (into == 3 and state == 2):
                heapq.heappush(queue, (cost + 2, audit + "I", at, into, (*out, (None, role))))
                if at < len(rows) and rows[at][1] not in ("blank", "duplicate"):
                    heapq.heappush(queue, (cost + 2 + (rows[at][1] == "truncated"), audit + "R", at + 1, into, (*out, (at, role))))
        if at < len(rows):
            role, fault = rows[at]
            heapq.heappush(queue, (cost + 3, audit + "D", at + 1, state, out))
            into = {"s": 1 if state == 0 else None, "u": 2 if state in (0, 1, 3) else None, "a": 3 if state == 2 else None}.get(role[:1])
            if into and fault not in ("blank", "duplicate"):
                heapq.heappush(queue, (cost + (fault == "truncated"), audit + "K", at + 1, into, (*out, (at, role))))


def brute_repair(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for c, turn, role, text in table:
            if c != conv:
                continue
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
            if kind == 0:
                continue
            text = "" if kind == 1 else text.translate({ord(x): None for x in ".!?"}) if kind == 2 else text
            rows += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        seen, faults = set(), []
        for _, role, text in rows:
            body = text.rstrip(BLANKS)
            faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
            seen.add((role, text))
        numbers = [r[0] for r in rows if r[0] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, final = repaired_by_search([(r[1], f) for r, f in zip(rows, faults, strict=True)])
        lines = [(role, "" if at is None else rows[at][2]) for at, role in final]
        n = Counter(faults)
        out[conv] = (gaps, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit, lines)
    return out


def chats():
    rng = random.Random(3)
    lines = ["Yes.", "No!", "And then", "", " \n", "Why? ", None, "…", "a?b", "Well.\t"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "s", "Assistant"]
    out = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            out.append((conv, rng.choice([turn, turn, turn, turn, None, turn * 3, 0]), rng.choice(roles[: 4 if conv % 3 else 10]), rng.choice(lines)))
    out += [(100, t, ("user", "assistant")[t % 2], f"{t}." if t % 7 else "Same.") for t in range(23)]
    out += [(None, 0, "user", "Hi."), (None, None, None, None)] + [(101, 1, "user", "Again.")] * 5 + out[:3]
    return out


def made(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, kind string, place int")


@pytest.mark.parametrize(("block", "fold"), [(1024, 256), (4, 2), (2, 1)])
def test_repair_against_search(spark, monkeypatch, block, fold):
    """Faults, costs, audits and repaired rows, in one run and in many short ones chained; nulls, ties and repeated rows."""
    monkeypatch.setattr(turns, "BLOCK", block)
    monkeypatch.setattr(turns, "FOLD", fold)
    want = brute_repair(chats())
    rows = turns.damaged(made(spark, chats()))
    got = {r.conv_id: r for r in turns.repair(rows).collect()}
    assert set(got) == set(want)
    for conv, w in want.items():
        r = got[conv]
        assert (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) == w[:7], conv
        assert r.repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in w[7]).encode()).hexdigest()
    if block == 1024:
        whole = {}
        for r in sorted(turns.repaired(rows).collect(), key=lambda r: r.place):
            whole.setdefault(r.conv_id, []).append((r.role, r.text))
        assert whole == {c: w[7] for c, w in want.items() if w[7]}


def test_repair_of_long_and_no_conversations(spark):
    rows = made(spark, [(1, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(5000)] + [(2, 7, "user", "x" * 1_000_000 + ".")])
    got = {r.conv_id: r for r in turns.repair(turns.undamaged(rows)).collect()}
    assert (got[1].cost, got[1].audit) == (0, "K" * 5000)
    assert (got[2].cost, got[2].audit) == (2, "KI")
    assert turns.repair(turns.damaged(rows.limit(0))).collect() == []


# ---------------------------------------------------------------- shards


def brute_tree(docs, shards):
    """doc index -> shard by sorting every node."""
    first = lambda s: -1 if s is None else int.from_bytes(s.encode()[:7].ljust(7, b"\0"), "big")
    keyed = []
    for i, (doc_id, text, lang, source) in enumerate(docs):
        raw = (text or "").encode()
        keyed.append(((first(source), first(lang), len(raw) + 1, -1 if doc_id is None else doc_id), zlib.crc32(raw), i))
    spread = [max(k[0][a] for k in keyed) - min(k[0][a] for k in keyed) for a in range(4)] if keyed else []
    out = {}

    def go(part, lo, n):
        if n == 1 or not part:
            out.update({k[2]: lo for k in part})
            return
        wide = [(max(k[0][a] for k in part) - min(k[0][a] for k in part)) / spread[a] if spread[a] else 0.0 for a in range(4)]
        axis = wide.index(max(wide))
        part = sorted(part, key=lambda k: (k[0][axis], k[0][3], k[1], k[2]))
        total, done, left = sum(k[0][2] for k in part), 0, n // 2
        for at, k in enumerate(part):
            size = k[0][2]
            if (done + size) * n >= total * left:
                at += (done + size) * n - total * left <= total * left - done * n
                break
            done += size
        go(part[:at], lo, left)
        go(part[at:], lo + left, n - left)

    go(keyed, 0, shards)
    return out


def placed(found):
    return Counter((r.doc_id, r.size, r.text_crc32, r.shard) for r in found)


@pytest.mark.parametrize(("shards", "bins"), [(16, 4096), (5, 4), (1, 4096)])
def test_tree_against_sorting(spark, documents, corpus, monkeypatch, shards, bins):
    """Cuts found in passes are those of sorting each node, with nulls, repeated rows and ids far apart."""
    monkeypatch.setattr(kdtree, "BINS", bins)
    rows = [*corpus, (-(1 << 62), "low"), (1 << 62, "high")]
    lang = lambda i, t: [None, "en", "de", "fr"][len(t or "") % 4]
    docs = documents(rows, lang)
    got = kdtree.shards(docs, shards).collect()
    brute = brute_tree([(i, t, lang(i, t), "s") for i, t in rows], shards)
    want = Counter((rows[k][0], len((rows[k][1] or "").encode()) + 1, zlib.crc32((rows[k][1] or "").encode()), s) for k, s in brute.items())
    assert placed(got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append((r.slot, r.doc_id))
    for s in slots.values():
        assert [x[0] for x in sorted(s)] == list(range(len(s)))
        ids = [-1 if x[1] is None else x[1] for x in sorted(s)]
        assert ids == sorted(ids)


def test_shards_of_copies_and_nothing(spark, documents, tmp_path):
    """One row many times over is cut anywhere; target bytes give the number of shards; an empty table gives no rows."""
    docs = documents([(1, "same text")] * 1000 + [(i, "other") for i in range(2, 60)])
    sizes = Counter()
    for r in kdtree.shards(docs, 16).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) <= 40
    total = sum(sizes.values())
    assert {r.shard for r in kdtree.shards(docs, target_bytes=total // 3).collect()} == {0, 1, 2, 3}
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_sharding(spark, str(tmp_path)).collect() == []


def test_sharding_stays_native(spark, documents):
    plan = kdtree.shards(documents([(1, "a"), (2, "b")]), 2)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "MapInPandas"))


# ---------------------------------------------------------------- filters


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    parts = {}
    for i, text, source in docs:
        text = text or ""
        words = [w for w in "".join(" " if c in BLANKS else c for c in text).split(" ") if w]
        fails = {f for f, x in zip("ABCDE", (len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), any(c in "#$%&*|" for c in text), i is not None and least[text] < i), strict=True) if x}
        parts.setdefault(source or "", []).append((fails, i in good, i in toxic))
    out = []
    for part, rows in parts.items():
        shapley, lines = Counter(), []
        for order in permutations("ABCDE"):
            left = list(rows)
            for step, f in enumerate(order, 1):
                hit, left_after = [r for r in left if f in r[0]], [r for r in left if f not in r[0]]
                shapley[f] += len(hit)
                redundant = sum(f in r[0] for r in rows) - len(hit)
                lines.append(((part, "".join(order), step, len(left_after), len(hit), redundant, sum(r[0] == {f} for r in rows), sum(r[1] for r in hit), sum(r[2] for r in hit)), f))
                left = left_after
        out += [(*line, shapley[f]) for line, f in lines]
    return sorted(out)


def test_audit_against_running_every_order(spark):
    rng = random.Random(9)
    texts = [None, "", " \n", "A b", "x & y", "WORD " * 60, " ".join(f"w{k}" for k in range(80)), "\t".join(f"w{k % 20}" for k in range(70)) + " #", "é" * 30 + "ABC", "word\x1cword " + " ".join(f"W{k}|" for k in range(55)), "long " * 200_000]
    docs = [(i, rng.choice(texts[:10]), rng.choice(["a", "b", None, ""])) for i in range(300)] + [(None, "A b", "a"), (None, None, None), (5, "A b", "b"), (5, "A b", "b"), (400, texts[10], "c"), (401, texts[10], "hot")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 1), (4, 0, 0), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, "clash", "clash", 3) for d in docs], "doc_id long, text string, source string, part string, digest string, n int")
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    tags = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = sorted(tuple(r[c] for c in names) for r in interactions.audit(frame, tags).collect())
    assert got == brute_audit(docs, labels)
    assert interactions.audit(frame.limit(0), tags).collect() == []
