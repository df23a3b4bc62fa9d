"""Operators 11 to 13 against plain versions."""

import hashlib
import heapq
import math
import random
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from doctree.llm import chat, fim, fingerprint, jaccard, langid, quality, repair, simhash, substrings
from doctree.sources.scratch import Tables

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"
TURNS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11. Conversation repair


def brute_audit(rows):
    """(cost, labels, turns) of the cheapest repair by a plain search over (cost, labels), rows as (role, text, gone, open)."""
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    heap, seen = [(0, "", 0, "", ())], {}
    best = None
    while heap:
        cost, labels, i, state, turns = heapq.heappop(heap)
        if best and (cost, labels) > best[:2] and cost > best[0]:
            break
        if i == len(rows) and state in ("", "a"):
            if best is None or (cost, labels) < best[:2]:
                best = cost, labels, turns
        if seen.get((i, state, labels), 1 << 30) <= cost or len(labels) > len(rows) * 2 + 4:
            continue
        seen[i, state, labels] = cost
        for r, name in (("u", "user"), ("a", "assistant")):
            if r in after[state]:
                heapq.heappush(heap, (cost + 3, labels + "I", i, after[state][r], (*turns, (name, ""))))
        if i < len(rows):
            role, text, gone, open_end = rows[i]
            heapq.heappush(heap, (cost + 4, labels + "D", i + 1, state, turns))
            if not gone:
                more = 3 if open_end else 0
                if role[:1] in after[state]:
                    heapq.heappush(heap, (cost + more, labels + "K", i + 1, after[state][role[:1]], (*turns, (role, text))))
                for r, name in (("u", "user"), ("a", "assistant")):
                    if r in after[state]:
                        heapq.heappush(heap, (cost + 3 + more, labels + "R", i + 1, after[state][r], (*turns, (name, text))))
    return best


def brute_report(rows):
    """What `report` says of one conversation's rows (turn, role, text), in order."""
    space = " \t\n\x0b\f\r"
    marked, seen, counts = [], set(), {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(space)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        marked.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    cost, labels, out = brute_audit(marked)
    return {"gaps": gaps, **counts, "illegal": sum(p not in ("su", "ua", "au") for p in pairs), "cost": cost, "audit": labels, "repaired_sha256": sha("\n".join(f"{r}:{t}" for r, t in out))}


def brute_order(rows):
    digest = lambda r: hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r)))


def random_conversations(seed, count, most=9):
    rng = random.Random(seed)
    rows = []
    for conv in range(count):
        turn = rng.randint(-2, 2)
        for _ in range(rng.randint(0, most)):
            turn += rng.choice([0, 1, 1, 1, 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv if conv else None, rng.choice([turn, turn, turn, None]), role, rng.choice(["Yes.", "No!", "Well", "é?", "Is it? ", "", None, " \n", "a.\x0b"])))
    return rows


@pytest.mark.parametrize("block", [1 << 16, 3])
def test_repair_equals_brute_force(spark, block):
    rows = random_conversations(3, 60)
    given = spark.createDataFrame(rows, TURNS).withColumns({c: F.lit("mine") for c in ("copies", "edits", "part", "digest", "which", "known")})
    found = {r["conv_id"]: r.asDict() for r in repair.report(given, block=block).collect()}
    convs = {r[0] for r in rows}
    assert set(found) == convs
    for conv in convs:
        own = brute_order([(t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv])
        assert found[conv] == {"conv_id": conv, **brute_report(own)}, (conv, own)
    turns = repair.repaired(given, block=block).orderBy("conv_id", "pos").collect()
    for conv in convs:
        assert sha("\n".join(f"{r['role']}:{r['text']}" for r in turns if r["conv_id"] == conv)) == found[conv]["repaired_sha256"]


def test_repair_of_long_conversations(spark):
    """One long conversation in many blocks has the edits that it has in one."""
    rng = random.Random(5)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", f"w{i}.", ""])) for i in range(3000)]
    given = spark.createDataFrame(rows, TURNS)
    whole, parts = repair.report(given).collect(), repair.report(given, block=50).collect()
    assert whole == parts and len(whole) == 1
    codes = b"".join(repair._codes((0, 0, 0, r["initial"], r["blank"], r["later"], r["open_end"], r["copies"])) for r in repair.faults(given).orderBy("known", "at", "digest").collect())
    composition = repair.Composition()
    vector, total, choices = composition.solve(codes, composition.end)
    assert whole[0]["cost"] == vector[0] + total
    edits, state = composition.walk(choices, 0)
    assert whole[0]["audit"] == "".join(edits) + composition.tails[state]


def test_repair_query(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    kept, ids = {}, {r["conv_id"] for r in given}
    for r in sorted(given, key=lambda r: (r["conv_id"], r["turn"])):
        how = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        text = "" if how == 1 else r["text"].translate({46: None, 33: None, 63: None}) if how == 2 else r["text"]
        row = (r["turn"], "user" if how == 4 else r["role"], text)
        kept.setdefault(r["conv_id"], []).extend([row] * (0 if how == 0 else 2 if how == 3 else 1))
    found = {r["conv_id"]: r.asDict() for r in repair.op11_repair(spark, SF).collect()}
    assert set(found) == ids
    for conv in ids:
        assert found[conv] == {"conv_id": conv, **brute_report(kept.get(conv, []))}


def test_repair_of_nothing(spark):
    assert repair.report(spark.createDataFrame([], TURNS)).count() == 0
    gone = spark.createDataFrame([(5, 1, "user", "x", 0)], TURNS + ", copies int")
    assert [r.asDict() for r in repair.report(gone, copies="copies").collect()] == [{"conv_id": 5, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "", "repaired_sha256": sha("")}]


# 12. SimHash


def brute_print(text, size=3):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode()
    words = low.split()
    grams = [b" ".join(words[i : i + size]) for i in range(max(len(words) - size + 1, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    roots = list(range(len(prints)))

    def root(i):
        while roots[i] != i:
            i = roots[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= 2:
            roots[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


@pytest.mark.parametrize("crowded", [128, 0])
def test_simhash_equals_brute_force(spark, crowded):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["Aé", "b", "C c", "dd", "E", "ff", "gg"]) for _ in range(n))
    texts = [None, "", " \t\n", "one", "one two", "One  TWO\x0b"]
    for _ in range(25):
        base = text(rng.randint(1, 80)).split(" ")
        for _ in range(4):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = "changed"
            texts.append(rng.choice([" ", "\n", "  "]).join(own))
    prints = [brute_print(t) for t in texts]
    found = {r["doc_id"]: r for r in simhash.linked_components(spark.createDataFrame(list(enumerate(texts)), DOCS), crowded=crowded).collect()}
    assert [found[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [found[i]["component_id"] for i in range(len(texts))] == brute_components(prints)


@pytest.mark.parametrize("crowded", [128, 2])
def test_links_lose_nothing(spark, crowded):
    """Random fingerprints, chains of close ones and dense clusters: the same components as all pairs give."""
    rng = random.Random(4)
    prints = {rng.getrandbits(64) for _ in range(100)}
    for base in list(prints)[:30]:
        for _ in range(12):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            prints.add(base)
    dense = rng.getrandbits(64)
    prints |= {dense ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3]))) for _ in range(150)} | {0, (1 << 64) - 1, 1 << 63}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    with Tables(spark) as tables:
        pairs = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "node long"), tables, crowded).collect()]
    assert all((a ^ b).bit_count() <= 2 for a, b in pairs)
    at, parent = {p: i for i, p in enumerate(prints)}, list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in pairs:
        x, y = root(at[a]), root(at[b])
        parent[max(x, y)] = min(x, y)
    assert [root(i) for i in range(len(prints))] == brute_components(prints)


def test_golay_code_is_perfect():
    code = simhash._code()
    assert code.rings[0].shape == (1 << 11, 1) and (code.rings[0] >= 0).all()
    index, anchor, home = simhash._anchors(np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 200))
    assert (np.bincount(index[home], minlength=200) == 1).all()
    words = np.concatenate([anchor & (1 << 23) - 1, anchor >> 23])
    assert (code.syndromes(words) == 0).all()


def test_simhash_keeps_one(spark):
    rows = [(3, "a b c d e"), (1, "A  b c d e"), (1, "A  b c d e"), (None, "a b c d e"), (None, "quite another text of words"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("fingerprint", "root", "_id", "_key")})
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == [(1, "A  b c d e"), (4, None)]
    assert simhash.linked_components(docs.limit(0)).count() == 0
    assert simhash.fingerprints(docs).columns[-1] == "fingerprint"
    long = "word " * 200_000
    assert simhash.fingerprints(spark.createDataFrame([(1, long)], DOCS)).first()["fingerprint"] % (1 << 64) == brute_print(long)


# 13. Fill in the middle


def brute_fim(doc_id, text):
    text = text or ""
    digest = sha(f"1:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fim_equals_brute_force(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aé<S>😀́\n ") for _ in range(rng.choice([0, 1, 2, 50, 3000, 9000]))) for _ in range(150)]
    rows = [*enumerate(texts), (None, "no id"), (900, None), (901, "<P>"), (902, "x" * 50_000), (902, "x" * 50_000)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("mine") for c in ("form", "restored", "units", "numbers")})
    made = fim.fill_in_middle(docs)
    back = fim.restore(made).collect()
    want = sorted((repr(i), *map(repr, brute_fim(i, t)), repr(t or "")) for i, t in rows)
    assert sorted((repr(r["doc_id"]), *(repr(r[c]) for c in ("units", "form", "prefix_chars", "middle_chars", "output", "restored"))) for r in back) == want
    assert {r[1] for r in map(lambda r: brute_fim(*r), rows)} == {"plain", "psm", "spm"}
    assert fim.restore(fim.fill_in_middle(docs.limit(0))).count() == 0


def test_fim_of_other_units(spark):
    docs = spark.createDataFrame([(i, " one, two\n three" * 500) for i in range(40)], DOCS)
    for r in fim.restore(fim.fill_in_middle(docs, pattern=r"\w+", changed=100)).collect():
        assert r["units"] == 1500 and r["restored"] == r["text"]
        ends = {0, *(m.end() for m in re.finditer(r"\w+", r["text"]))}
        assert r["prefix_chars"] in ends and r["prefix_chars"] + r["middle_chars"] in ends


def test_ropes():
    rng = random.Random(6)
    units, whole = fim.Units(), "".join(rng.choice("abcdé") for _ in range(100_000))
    rope = fim.rope_of(whole, units)

    def checked(node):
        if isinstance(node, fim.Leaf):
            return node.points
        assert abs(node.left.height - node.right.height) <= 1
        assert checked(node.left) + checked(node.right) == node.points == node.units
        return node.points

    for _ in range(200):
        a, b = sorted((rng.randint(0, len(whole)), rng.randint(0, len(whole))))
        head, rest = fim.split(rope, a, units)
        middle, tail = fim.split(rest, b - a, units)
        rope = fim.concat(tail, head, middle)
        whole = whole[b:] + whole[:a] + whole[a:b]
        checked(rope)
        assert rope.height <= 20
    assert fim.text_of(rope) == whole


# Trainers of operators 6 and 8 against plain loops, and long texts


def plain_ftrl(rows, epochs=4, alpha=0.5, beta=1.0, l1=0.02, l2=0.02):
    """FTRL-proximal one coordinate at a time, in dictionaries; -1 is the bias."""
    z, n = {}, {}

    def weight(i):
        zi = z.get(i, 0.0)
        if abs(zi) <= l1:
            return 0.0
        return -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for _ in range(epochs):
        for index, values, label in rows:
            some = [*zip(index.tolist(), values.tolist()), (-1, 1.0)]
            w = {i: weight(i) for i, _ in some}
            p = 1 / (1 + math.exp(-sum(w[i] * v for i, v in some)))
            for i, v in some:
                g = (p - label) * v
                was = n.get(i, 0.0)
                z[i] = z.get(i, 0.0) + g - (math.sqrt(was + g * g) - math.sqrt(was)) / alpha * w[i]
                n[i] = was + g * g
    return {i: weight(i) for i in z}


def test_ftrl_equals_a_plain_loop():
    rng = np.random.default_rng(4)
    rows = [(np.unique(rng.integers(0, 300, 30)), None, int(rng.integers(0, 2))) for _ in range(80)]
    rows = [(i, rng.uniform(0, 2, len(i)), y) for i, _, y in rows]
    model, plain = quality.train(rows), plain_ftrl(rows)
    assert abs(model.bias - plain.pop(-1)) < 1e-9
    assert np.allclose(model.weights[sorted(plain)], [plain[i] for i in sorted(plain)], atol=1e-6)
    assert not np.delete(model.weights, sorted(plain)).any() and (model.weights == 0).sum() > 0


def plain_softmax(rows, epochs=3, rate=0.5, seed=5):
    """Logits of every bucket by gradient descent over lists; the start and the order are those of the seed."""
    langs = sorted({x[2] for x in rows})
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / langid.SIZE, 1 / langid.SIZE, (1 << langid.BITS, langid.SIZE))
    vectors, out = {}, [[0.0] * len(langs) for _ in range(langid.SIZE)]
    learn = [x for i, x in enumerate(rows) if i % 8 or len(rows) < 64]
    done = 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            index, times, lang = learn[i]
            lr = rate * (1 - done / (epochs * len(learn)))
            done += 1
            index, share = index.tolist(), [t / sum(times) for t in times]
            own = [vectors.setdefault(k, table[k].tolist()) for k in index]
            hidden = [sum(s * v[j] for s, v in zip(share, own)) for j in range(langid.SIZE)]
            logits = [sum(hidden[j] * out[j][k] for j in range(langid.SIZE)) for k in range(len(langs))]
            top = max(logits)
            odds = [math.exp(x - top) for x in logits]
            error = [o / sum(odds) - (langs[k] == lang) for k, o in enumerate(odds)]
            back = [sum(out[j][k] * error[k] for k in range(len(langs))) for j in range(langid.SIZE)]
            for j in range(langid.SIZE):
                for k in range(len(langs)):
                    out[j][k] -= lr * hidden[j] * error[k]
            scale = len(index) / max(max(share) * len(index), 1)
            for s, v in zip(share, own):
                for j in range(langid.SIZE):
                    v[j] -= lr * s * scale * back[j]
    return langs, {k: [sum(v[j] * out[j][x] for j in range(langid.SIZE)) for x in range(len(langs))] for k, v in vectors.items()}


def test_softmax_equals_a_plain_loop():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(100):
        index, times = np.unique(rng.integers(0, 200, 25), return_counts=True)
        rows.append((index, times.astype(float), f"l{rng.integers(0, 3)}"))
    model, (langs, logits) = langid.train(rows), plain_softmax(rows)
    assert model.langs == langs
    assert np.allclose(model.table[sorted(logits)], [logits[k] for k in sorted(logits)], atol=1e-6)


def test_very_long_texts(spark):
    """Texts of half a million words: fingerprints, languages and chunks, the same as those of the text alone; and a conversation of 20,000 turns."""
    rng = random.Random(1)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500_000))
    docs = spark.createDataFrame([(1, long), (2, "short text"), (3, long + " more")], DOCS)
    prints = {r["doc_id"]: r for r in fingerprint.fingerprints(docs).collect()}
    assert prints[1]["fingerprint"] != prints[2]["fingerprint"] and len(prints) == 3
    model = langid.fit(spark.createDataFrame([(i, f"{'abc' if i % 2 else 'xyz'} word {i}", "ab"[i % 2]) for i in range(100)], DOCS + ", lang string"))
    assert {r["lang_pred"] for r in langid.identify(docs, model, reject=False).collect()} <= {"a", "b"}
    found = {r["doc_id"]: r for r in substrings.annotate(docs).collect()}
    assert sum(s.end - s.start for s in found[3]["removed"]) > 0.999 * len(long) and not found[1]["removed"]
    turns = spark.createDataFrame([(1, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(20_000)], TURNS)
    digest = hashlib.sha256("".join(f"{('user', 'assistant')[i % 2]}\nturn {i}.\n" for i in range(20_000)).encode()).hexdigest()
    got = chat.read_back(chat.format_conversations(turns, piece=1000)).collect()
    assert [(r["n_turns"], r["turns_sha256"]) for r in got] == [(20_000, digest)]
    assert chat.read_back(chat.format_conversations(turns.limit(0))).count() == 0


# Operator 4: sets of equal hash


def test_sets_of_one_hash_are_told_apart(spark):
    rows = [(1, 5, 100, 7), (2, 5, 100, 7), (3, 5, 200, 8), (4, 6, 1, 7), (5, 0, 0, 0), (6, 0, 0, 0)]
    sketches = spark.createDataFrame(rows, "doc_id long, node long, check long, n_shingles int")
    with Tables(spark) as tables:
        nodes = {r["doc_id"]: r["node"] for r in jaccard.told_apart(sketches, tables).collect()}
        assert nodes[1] == nodes[2] != nodes[3] and nodes[4] == 6 and nodes[5] == nodes[6] == 0
        plain = jaccard.told_apart(sketches.filter("doc_id <> 3"), tables)
        assert {r["node"] for r in plain.collect()} == {5, 6, 0}
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 1 << 63, 20, dtype=np.uint64)) for _ in range(200)]
    assert len({jaccard._set_check(s) for s in sets}) == 200 and jaccard._set_check(sets[0]) == jaccard._set_check(sets[0].copy())
