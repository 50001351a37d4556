import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash

from marlstone.llm import decontam, lmscore, mixing, quality, simhash, tokenbin
from marlstone.llm.perfecthash import PerfectHash

from .helpers import LOWER, documents, frame

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_measures(spark):
    rows = documents()
    labels = spark.createDataFrame([(r[0], int(i % 3 > 0), 0) for i, r in enumerate(rows[:60])] + [(None, 1, 0)], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r for r in quality.rate(frame(spark, rows), labels).collect()}
    for key, text, _ in rows:
        if key is None:
            continue
        text, seen, repeats = text or "", set(), 0
        words, places = WORD.findall(text), {}
        for i in range(len(words) - 2):
            places.setdefault(tuple(words[i : i + 3]), []).append(i)
        covered = {j for v in places.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
        for line in text.split("\n"):
            if WORD.search(line):
                repeats += line in seen
                seen.add(line)
        row = found[key]
        assert (row["n_words"], row["word_chars"], row["n_dup_lines"], row["n_repeat_words"]) == (len(words), sum(map(len, words)), repeats, len(covered))
        assert row["n_symbols"] == sum(c in "#*$%&|<>" for c in text)
        assert row["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words))
        assert not (row["kept"] and row["base_failed"])
    assert quality.rate(frame(spark, []), labels).count() == 0
    assert {r["score"] for r in quality.rate(frame(spark, rows), labels.limit(0)).collect()} == {0.0}


def test_quality_score_is_the_mean_log_ratio(spark):
    good = [(i, " ".join(random.Random(i).choices(["alpha", "beta", "gamma", "delta"], k=120)), "s") for i in range(40)]
    bad = [(100 + i, " ".join(random.Random(i).choices(["BUY!!", "NOW!!", "$$$", "|"], k=120)), "s") for i in range(10)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    found = {r["doc_id"]: r["score"] for r in quality.rate(frame(spark, good + bad), labels).collect()}
    assert min(found[i] for i in range(40)) > 0 > quality.THRESHOLD > max(found[100 + i] for i in range(10))


def _decontaminated(texts, items):
    pattern, windows = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), {}
    words = lambda t: pattern.findall((t or "").translate(LOWER))
    for key, text in items:
        w = words(text)
        size = min(10, len(w))
        for s in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + size]), set()).add(key)
    for text in texts:
        w, hit, of = words(text), set(), set()
        for size in {len(k) for k in windows}:
            for s in range(len(w) - size + 1):
                if tuple(w[s : s + size]) in windows:
                    hit |= set(range(s, s + size))
                    of |= windows[tuple(w[s : s + size])]
        yield len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(map(str, of))).encode()).hexdigest(), bool(hit)


def test_contamination(spark):
    rng = random.Random(3)
    items = [(i, " ".join(rng.choices("the of a and cat dog sun red blue tree é".split(), k=rng.randint(1, 40)))) for i in range(30)] + [(90, ""), (91, None), (92, "a a a a a a a a a a a a")]
    items.append((93, items[0][1]))
    rows = documents(40)
    for i in range(60):
        part = rng.choice(items[:30])[1].split()
        at = rng.randint(0, len(part) - 1)
        rows.append((2000 + i, "zz " + "! ".join(part[at : at + rng.randint(3, 25)]).upper().replace("É", "é") + " zz yy", "s"))
    rows.append((3000, "a " * 40, "s"))
    benchmark = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "'x' AS words", "1 AS length")
    found = decontam.contamination(frame(spark, rows), benchmark).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in found)
    assert got == sorted((str(k), *e) for (k, _, _), e in zip(rows, _decontaminated([t for _, t, _ in rows], items), strict=True))
    assert decontam.contamination(frame(spark, []), benchmark).count() == 0
    assert decontam.contamination(frame(spark, rows), benchmark.limit(0)).where("contaminated").count() == 0
    kept = decontam.drop_contaminated(frame(spark, rows), benchmark)
    bad = {g[0] for g in got if g[5]}
    assert {str(r["doc_id"]) for r in kept.select("doc_id").collect()} == {g[0] for g in got} - bad


def test_probing_in_parts(spark, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(60)))], "item_id bigint, text string")
    rows = [(1, " ".join(f"w{i}" for i in range(20, 45)), "s"), (2, "nothing", "s")]
    whole = sorted(map(tuple, decontam.contamination(frame(spark, rows), items).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 9)
    assert sorted(map(tuple, decontam.contamination(frame(spark, rows), items).collect())) == whole and whole[0][2] == 25


def _fingerprint(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def _classes(prints, radius=3):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_near_duplicates(spark):
    rows = [r for r in documents(120) if r[0] is not None]
    rows += [(7000 + i, rows[i][1] + " and more", "s") for i in range(20) if rows[i][1]]
    prints = [_fingerprint(t) for _, t, _ in rows]
    least = {}
    roots = _classes(prints)
    for (key, _, _), root in zip(rows, roots, strict=True):
        least[root] = min(least.get(root, key), key)
    want = sorted((k, f"{p:016x}", least[r]) for (k, _, _), p, r in zip(rows, prints, roots, strict=True))
    assert sorted(map(tuple, simhash.near_duplicates(frame(spark, rows)).collect())) == want
    kept = sorted(r["doc_id"] for r in simhash.keep_one(frame(spark, rows)).collect())
    assert kept == sorted(set(least.values()))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("large", [8, 10_000])
def test_links_of_a_dense_ball(spark, large):
    rng, base, prints = random.Random(1), random.Random(2).getrandbits(64), set()
    while len(prints) < 400:
        x = base
        for b in rng.sample(range(64), rng.randint(0, 6)):
            x ^= 1 << b
        prints.add(x)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp bigint"), 3, large)
    roots = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    got = collections.defaultdict(set)
    for s in signed:
        got[roots.get(s, s)].add(s)
    want = collections.defaultdict(set)
    for s, r in zip(signed, _classes(prints), strict=True):
        want[r].add(s)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_every_close_pair_meets_in_a_table():
    masks = simhash.covering_masks(3)
    rng = random.Random(0)
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3)))
        assert any(not d & m for m in masks)


def test_mix(spark):
    rows = documents(100)
    first = sorted(map(str, mixing.mix(frame(spark, rows)).collect()))
    found = mixing.mix(frame(spark, rows)).collect()
    assert sorted(map(str, found)) == first and len(found) == len(rows)
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights, caps, total = [(5, 2, 1)[i % 3] for i in range(len(names))], [3 * sizes[s] for s in names], sum(sizes.values())
    targets, open_ = [0.0] * len(names), set(range(len(names)))
    while True:
        left = total - sum(targets[i] for i in range(len(names)) if i not in open_)
        share = {i: left * weights[i] / sum(weights[j] for j in open_) for i in open_}
        over = [i for i in open_ if share[i] > caps[i]]
        if not over:
            for i in open_:
                targets[i] = share[i]
            break
        for i in over:
            targets[i] = caps[i]
            open_.discard(i)
    by_source = collections.defaultdict(set)
    source_of = {r[0]: r[2] for r in rows}
    for r in found:
        assert 0 <= r["taken"] <= 3 * r["size"]
        by_source[source_of[r["doc_id"]]].add((r["source_size"], round(r["target"], 6)))
    for name, target in zip(names, targets, strict=True):
        assert (sizes[name], round(target, 6)) in by_source[name]
    words, targets_of = collections.Counter(), dict(zip(names, targets, strict=True))
    for r in found:
        words[source_of[r["doc_id"]]] += r["taken"]
    for name in names:
        assert abs(words[name] - targets_of[name]) <= 0.02 * targets_of[name] + 3
    assert mixing.mix(frame(spark, [])).count() == 0
    again = mixing.sample(frame(spark, rows))
    assert again.count() == sum(r["taken"] // r["size"] for r in found if r["size"])


@pytest.mark.parametrize("seed", range(20))
def test_subset_sums(seed):
    rng = random.Random(seed)
    lengths = rng.sample(range(1, 200), 12)
    counts = [rng.randint(1, 9) for _ in lengths]
    budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts, strict=True)))
    taken = mixing.fit_subset(lengths, counts, budget)
    assert all(0 <= t <= c for t, c in zip(taken, counts, strict=True))
    assert 0 <= budget - sum(n * t for n, t in zip(lengths, taken, strict=True)) <= min(lengths) + 3


def test_token_shards(spark):
    from tokenizers import Tokenizer

    rows = documents(80) + [(4000 + i, t, "s") for i, t in enumerate(["<|endoftext|> x", "don't  stop\n\nnow", "123abc,,Ω", "  "])]
    found = tokenbin.encode_documents(frame(spark, rows)).collect()
    tokenizer, start, want = Tokenizer.from_file(tokenbin.tokenizer_path()), 0, []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    ids = {(k, t): np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for k, t, _ in order}
    for k, t, _ in order:
        want.append((k, len(ids[k, t]), zlib.crc32(ids[k, t].tobytes())))
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found if r["doc_id"] is not None) == sorted(w for w in want if w[0] is not None)
    for r in sorted(found, key=lambda r: r["start"]):
        assert r["start"] == start
        start += r["n_tokens"]
    assert [r["doc_id"] for r in sorted(found, key=lambda r: r["start"])] == [w[0] for w in want]
    assert tokenbin.encode_documents(frame(spark, [])).count() == 0


def test_keyed_access(spark, tmp_path):
    folder = f"file://{tmp_path}/shards"
    rows = [(i * 7, f"text {i}", "s") for i in range(50)] + [(7, "again", "s")]
    manifest = tokenbin.write_shards(frame(spark, rows), folder, tokenbin.tokenizer_path())
    coder = tokenbin.coder(tokenbin.tokenizer_path())
    wide = lambda t: np.append(np.frombuffer(coder.encode([t])[0], coder.dtype), 0).astype("<u4").tobytes()
    shards = [tokenbin.Shard(folder, m["name"]) for m in manifest]
    assert sorted(x for s in shards for x in s.rows(7)) == sorted([wide("text 1"), wide("again")])
    assert [x for s in shards for x in s.rows(8)] == []


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64))
    index = PerfectHash.build(keys)
    assert sorted(index.slots(keys).tolist()) == list(range(len(keys)))


def test_language_model_scores(spark):
    rows = documents(150)
    found = lmscore.score(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    tokens = [(k, (t or "").encode().translate(bytes.maketrans(b"", b"")).lower().split() + [None]) for k, t, _ in rows]
    held = lambda k: zlib.crc32(b"" if k is None else str(k).encode()) % 7 == 2
    counts = collections.Counter(w for k, ws in tokens if not held(k) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = {(k, len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 4), held(k)) for k, ws in tokens}
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4), r["held_out"]) for r in found} == want
    assert all(r["score"] < 0 for r in found)
    assert lmscore.score(frame(spark, [])).count() == 0


def test_language_model_is_a_distribution():
    """All documents of one word of up to two letters have at most the probability 1 together, and a sure one is likely."""
    from marlstone.llm import ctxmix

    model = ctxmix.fit([b"ab abc ba cab"] * 5 + [b"ab"] * 20, [b"ab", b"abc"], [25, 5])
    letters = [bytes([c]) for c in range(256) if c not in b" \t\n\r\x0b\x0c" and not 65 <= c <= 90]
    short = [b"", *letters, *(a + b for a in letters for b in letters)]
    assert 0.1 < (10.0 ** model.costs(short)).sum() <= 1.0 + 1e-6
    ab, zq = model.costs([b"ab", b"zq"])
    assert ab > -0.5 and zq < ab - 2


def test_language_model_code():
    """The code has a path for every symbol and byte, and no path begins another one."""
    from marlstone.llm import ctxmix

    code = ctxmix.Code.fitted([f"w{i}".encode() for i in range(50)], np.arange(50, 0, -1), 7, 3)
    paths = [tuple((code.packed[b : b + n] & 1).tolist()) for b, n in zip(code.begins, code.sizes, strict=True)]
    for some in (paths[:52], paths[52:]):
        assert sum(2.0 ** -len(p) for p in some) == 1.0 and len(set(some)) == len(some)
    symbols = np.arange(52)
    for s in (1, 5, 51):
        shared = ctxmix.agreement(code, symbols, np.full(52, s))
        want = [len(paths[t]) if t == s else next(i for i, (a, b) in enumerate(zip(paths[t], paths[s], strict=False)) if a != b) for t in range(52)]
        assert shared.tolist() == want


def test_language_model_charges_every_byte(spark):
    """An unseen token's cost goes on with its length; it has no floor."""
    rng = random.Random(4)
    held = [k for k in range(5000, 6000) if lmscore.held_out(k)][:3]
    long = "".join(rng.choices("bcdfghjklmnpqrstvwxz0123456789+/", k=5000))
    texts = [long[:200], long[:400], long]
    rows = [r for r in documents(60) if r[0] is not None] + [(k, t, "s") for k, t in zip(held, texts, strict=True)]
    found = {r["doc_id"]: r for r in lmscore.score(frame(spark, rows)).where("doc_id >= 5000 AND doc_id < 6000").collect()}
    short, middle, all_ = (found[k]["score"] for k in held)
    assert middle < 1.5 * short and all_ < 10 * middle
    assert all(found[k]["bits_per_byte"] > 1 for k in held)


def test_language_model_reads_every_token_in_context(spark):
    """Seen words in an order that was learnt are likelier than the same words in another one."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(40)]
    held = [k for k in range(5000, 6000) if lmscore.held_out(k)][:2]
    train = [(k, " ".join(words * 5), "s") for k in range(7000, 7060) if not lmscore.held_out(k)]
    rows = [*train, (held[0], " ".join(words), "s"), (held[1], " ".join(rng.sample(words, 40)), "s")]
    found = {r["doc_id"]: r for r in lmscore.score(frame(spark, rows)).collect()}
    learnt, other = (found[k] for k in held)
    assert learnt["n_known"] == other["n_known"] == 41 and learnt["base_score"] == pytest.approx(other["base_score"])
    assert learnt["bits_per_byte"] < 0.8 * other["bits_per_byte"]


def test_language_model_keeps_every_context():
    """Whatever the number of contexts, each keeps the token that followed it: what was read is likely, all of it."""
    from marlstone.llm import ctxmix

    words = [f"w{i}".encode() for i in range(300)]
    random_ = np.random.default_rng(8)
    train = [b" ".join(words[i] for i in random_.integers(0, len(words), 1000)) for _ in range(200)]
    counts = collections.Counter(w for t in train for w in t.split())
    frequent = sorted(words, key=lambda w: -counts[w])
    model = ctxmix.fit(train, frequent, [counts[w] for w in frequent])
    some = train[::20]
    costs = -model.costs(some) / math.log10(2) / 1001
    assert costs.max() < 4  # bits a token; the words alone have 8.2, and 7.2 where contexts share 2^18 slots


def test_language_model_matches_as_brute_force():
    """The votes of a token's contexts are those of all their occurrences, in whatever parts they are counted."""
    from marlstone.llm import ctxmix

    rng = random.Random(3)
    text = lambda n: b" ".join(rng.choices([b"a", b"b", b"c", b"d", b"zz"], [8, 4, 2, 1, 1], k=n))
    code = ctxmix.Code.fitted([b"a", b"b", b"c", b"d"], np.array([8, 4, 2, 1]), 9, 1)
    train, other = [text(60) for _ in range(40)], [text(60) for _ in range(10)]
    votes = [collections.defaultdict(collections.Counter) for _ in ctxmix.ORDERS]
    walk = lambda t: [([b"\n"] * 4 + (ws := t.split() + [b"\n"]))[i : i + 5] for i in range(len(t.split()) + 1)]
    for t in train:
        for five in walk(t):
            for v, order in zip(votes, ctxmix.ORDERS, strict=True):
                v[tuple(five[4 - order : 4])][five[4]] += 1
    (trained,), (batch,) = list(ctxmix.batches(train, code)), list(ctxmix.batches(other, code))
    found = ctxmix.matches(batch, ctxmix.asks(trained, True)[0], code)
    asked, begins, place = ctxmix.asks(batch, False, 7)
    dealt, dealt_begins, _ = ctxmix.asks(trained, True, 7)
    by_part = []
    for p in range(7):
        pieces = [dealt[:, dealt_begins[p] : dealt_begins[p + 1]], asked[:, begins[p] : begins[p + 1]]]
        by_part.append(ctxmix.answers(np.concatenate(pieces, axis=1), code)[:, pieces[0].shape[1] :])
    assert np.array_equal(np.concatenate(by_part, axis=1)[:, place], found)
    for k in range(len(ctxmix.ORDERS)):
        for i, five in enumerate(five for t in other for five in walk(t)):
            most = votes[k][tuple(five[4 - ctxmix.ORDERS[k] : 4])].most_common(2)
            lead = most[0][1] - (most[1][1] if len(most) > 1 else 0) if most else 0
            assert found[2 * k, i] == min(lead, ctxmix.MOST_VOTES)
            assert not lead or (found[2 * k + 1, i] == ctxmix.SAME) == (most[0][0] == five[4])


def test_batches_carry_contexts(monkeypatch):
    """A document costs the same wherever batches and parts cut it, whatever comes before it, and as one of many."""
    from marlstone.llm import ctxmix

    words = [b"one", b"two", b"three", b"four"]
    train = [b"one two three four one two three four five", b"two three four one", b"long" * 30 + b" two three", b""] * 4
    model = ctxmix.fit(train, words, [16, 16, 16, 12])
    documents = [b"one two three four one two", b"", b"x" * 9000 + b" three four ONE", b"one  two\tthree five four"]
    whole = model.costs(documents)
    assert (whole < 0).all() and np.allclose(whole, [model.costs([d])[0] for d in documents])
    monkeypatch.setattr(ctxmix, "BATCH_TOKENS", 1)
    monkeypatch.setattr(ctxmix, "SPLIT_BYTES", 5)
    assert np.allclose(model.costs(documents), whole)
    body = next(ctxmix.batches(documents, model.code)).to_bytes()
    assert ctxmix.Batch.from_bytes(body).to_bytes() == body


def test_language_model_memory():
    """What a worker holds at once: the counting of contexts takes few numbers an ask, and what is broadcast arrives as
    itself, without the lexicon's words where symbols are enough."""
    import pickle
    import tracemalloc

    from marlstone.llm import ctxmix

    words = [f"w{i}".encode() for i in range(1000)]
    code = ctxmix.Code.fitted(words, np.arange(1000, 0, -1), 7, 3)
    asked = np.random.default_rng(1).integers(0, 1000, (6, 200_000)).astype(np.uint32)
    tracemalloc.start()
    try:
        found = ctxmix.answers(asked, code)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 130 * asked.shape[1]
    arrived = pickle.loads(pickle.dumps(lmscore._Packed(code.bare())))
    assert not arrived.symbols and arrived.words == code.words
    assert np.array_equal(ctxmix.answers(asked, arrived), found)


def test_language_model_memory_of_the_driver():
    """The frequent tokens' table, the driver's largest, isn't copied as a whole."""
    import tracemalloc

    from marlstone.llm import ctxmix

    width, rng = 2 << ctxmix.LINE_BITS, np.random.default_rng(2)
    whole = rng.integers(0, 9, (60_000, width)).astype(np.uint32) * (rng.random(60_000) < 0.7)[:, None].astype(np.uint32)
    tracemalloc.start()
    try:
        table, lines = ctxmix.line_up(whole.size, ((lo * width, whole[lo : lo + 4096]) for lo in range(0, len(whole), 4096)))
        tracemalloc.reset_peak()
        odds = ctxmix.odds_of(table)
        peak = tracemalloc.get_traced_memory()[1] - table.nbytes
    finally:
        tracemalloc.stop()
    assert np.array_equal(table.reshape(-1, width)[lines], whole)
    assert np.array_equal(odds, np.log((table[1::2] + ctxmix.DELTA) / (table[0::2] + ctxmix.DELTA)).astype(np.float32))
    assert peak < 1.2 * table.nbytes


def test_long_values_are_staged_in_small_groups(spark):
    """A row group is read whole; a hundred rows of a batch each are too many for one."""
    from pyspark.sql import functions as F

    from marlstone.session import staged

    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(1 << 14)), lambda i: F.md5(F.concat_ws(" ", "id", i))), "")
    df = staged(spark.range(0, 60, 1, 1).select("id", body.alias("body")), "long", bodies=True)
    groups = [f.metadata.row_group(g) for f in map(_parquet, df.inputFiles()) for g in range(f.metadata.num_row_groups)]
    assert sum(g.num_rows for g in groups) == df.count() == 60
    assert max(g.num_rows for g in groups) <= 32  # of 0.5 MB each, which hardly shrink
    assert df.select("id", F.length("body").alias("n")).agg(F.sum("id"), F.min("n")).first()[:] == (1770, 1 << 19)


def _parquet(path):
    import pyarrow.parquet as pq

    return pq.ParquetFile(path.removeprefix("file:").replace("///", "/"))
