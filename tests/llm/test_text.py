import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import leaks, packing, textbytes, tone

from .probes import MORE, PROBES

VOCABULARY = Path(packing.DEFAULT_VOCABULARY)
WORDS = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return [rng.choice(WORDS) for _ in range(n)]


def brute(docs, items):
    def words(t):
        t = textbytes.readable((t or "").encode("utf-8", "replace"))
        return re.findall(r"[^\W_]+", re.sub(r"\\+[nrt]", " ", t).lower())

    out = set()
    for i, p in items:
        w = words(p)
        for d, t in docs:
            x = words(t)
            runs = {tuple(x[k : k + 8]) for k in range(len(x) - 7)}
            mark = set()
            for k in range(len(w) - 7):
                if tuple(w[k : k + 8]) in runs:
                    mark |= set(range(k, k + 8))
            if mark and len(mark) * 5 >= len(w) * 2:
                out.add((d, i, len(mark), len(w)))
    return out


def leak_rows(spark, docs, items, parts=3):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(5)).repartition(parts)
    i = spark.createDataFrame(items, "item_id long, passage string").withColumn("text", F.lit("x"))
    return {tuple(r) for r in leaks.find_leaks(d, i).select("doc_id", "item_id", "covered_words", "passage_words").collect()}


def planted(seed=1, n=60):
    rng = random.Random(seed)
    lead = sentence(rng, 11)  # shared by all items
    items = [(k, " ".join(lead + sentence(rng, rng.randrange(20, 90)))) for k in range(20)]
    items += [(50, items[3][1]), (51, ""), (52, None), (53, "too short to leak"), (54, " ".join(lead[:8]))]
    docs = []
    for d in range(n):
        text = sentence(rng, rng.randrange(0, 200))
        for _ in range(rng.choice([0, 1, 1, 2])):
            w = items[rng.randrange(20)][1].split()
            a, b = sorted((rng.randrange(len(w)), rng.randrange(len(w) + 1)))
            part = w[a:b]
            for _ in range(rng.choice([0, 0, 3])):
                if part:
                    part[rng.randrange(len(part))] = "zz"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        joiner = rng.choice([" ", ".\n// ", '\\n" +\n  "', "…", "\\u2026", "\r\n * ", " -- "])
        t = joiner.join(text)
        docs.append((d, t.upper() if rng.random() < 0.2 and "\\" not in joiner else t))
    return docs + [(900, None), (901, ""), (902, "\x00� … ​")], items


def test_leaks_equal_brute_force(spark):
    docs, items = planted()
    want = brute(docs, items)
    assert leak_rows(spark, docs, items) == want and len(want) > 15


def test_leaks_in_blocks_and_pieces(spark, monkeypatch):
    docs, items = planted(2, 25)
    want = brute(docs, items)
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 900)
    assert leak_rows(spark, docs, items) == want
    monkeypatch.setattr(textbytes, "PIECE", 64)
    known = leaks.prepare([i for i, _ in items], [p for _, p in items])
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in docs], pa.string())], ["text"])
    got = set()
    for words, counts, rows in leaks.texts_as_words(batch, "text"):
        got |= {(docs[int(rows[t])][0], int(known.item_id[i]), n, of) for t, i, n, of in leaks.matches(words, counts, known)}
    assert got == want


def test_leaks_of_empty_tables(spark):
    docs, items = planted(3, 3)
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string")
    assert leaks.find_leaks(d.limit(0), i).count() == leaks.find_leaks(d, i.limit(0)).count() == 0
    both = leaks.find_leaks(d.unionByName(d), i)
    assert both.count() == leaks.find_leaks(d, i).count()
    assert leaks.leaks_by_item(both).count() >= 0


def test_every_run_of_eight_shares_a_fingerprint():
    rng = np.random.default_rng(1)
    for _ in range(200):
        run = rng.integers(1, 1000, 8).astype(np.uint64)
        texts = [np.concatenate([rng.integers(1, 1000, rng.integers(0, 20)).astype(np.uint64), run, rng.integers(1, 1000, rng.integers(0, 20)).astype(np.uint64)]) for _ in range(2)]
        a, b = (set(leaks.winnow(t, np.array([len(t)]))[1].tolist()) for t in texts)
        assert a & b


def test_windows_do_not_cross_texts():
    rng = np.random.default_rng(2)
    texts = [rng.integers(1, 50, n).astype(np.uint64) for n in (3, 0, 8, 20, 7, 1, 12)]
    kept, prints = leaks.winnow(np.concatenate(texts), np.array([len(t) for t in texts]))
    alone = [p for t in texts for p in leaks.winnow(t, np.array([len(t)]))[1].tolist()]
    assert prints.tolist() == alone and len(kept) == len(prints)


def scores(texts):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(["s"] * len(texts)), pa.array(texts, pa.string())], ["doc_id", "source", "text"])
    peak, total, words = tone.score_batch(batch, tone.the_lexicon())
    return [{n for n, x in zip(tone.NAMES, p, strict=True) if x >= tone.THRESHOLD} for p in peak], total, words


DISGUISES = [
    "shut up, you pathetic moron", "SHUT UP, YOU PATHETIC MORON", "sh​ut up, you path​etic moron", "shut up, you p4th3t1c m0r0n", "shut up, you p.a.t.h.e.t.i.c m.o.r.o.n", "s h u t u p, you p a t h e t i c m o r o n",
    "shhhhut up, you patheeeetic morrrron", "shut up, you p*thetic m*ron", "ѕhut uр, yоu pаthetic mоrоn", "x = 1;\n// shut up, you\n// pathetic moron\n", '"shut up," +\n  " you pathetic moron"', "a\\nshut up, you pathetic moron\\nb",
    "def shut_up_you_pathetic_moron():", "shut up, you p a t h e t i\n// c m o r o n", '"s h u t u p, y o " + "u p a t h e t i c m o r o n"', "shut up, you \\u0070athetic moron",
]


@pytest.mark.parametrize("text", DISGUISES)
def test_disguised_insults(text):
    assert scores([text, "plain", text + "!"])[0] == [{"abusive"}, set(), {"abusive"}]


CLEAN = [
    "class Assassin extends Assertion with a cockpit analysis", "Scunthorpe and Essex share a title page", "pond scum sampled weekly; pussy willow flowers; great tits at the feeder", "kill the child process and reap the zombie",
    "race condition: one thread is starved to death", "the whole s.c.u.m model", "his hit list", "bass guitar and grass seed", "int assess = a*b*c;", "", None, "\x00\x01", "sex: M or F", "he is a bastard file owner",
]


def test_clean_texts():
    assert scores(CLEAN)[0] == [set()] * len(CLEAN)


GENERAL = [
    ("you are an idiot", "abusive"), ("you fucking idiots", "abusive"), ("only a buffoon like you could write this", "abusive"), ("she is such a nitwit", "abusive"), ("you're completely useless", "abusive"),
    ("somebody should strangle you", "abusive"), ("I will smash your kneecaps and your skull; I'm going to smash your skull", "abusive"), ("we know where your sister works", "abusive"), ("I hope you rot", "abusive"), ("y o u  a r e  a n  i d i o t", "abusive"),
    ("those Velborians are all thieves", "hateful"), ("Quennites are nothing but vermin", "hateful"), ("the Dorvish must be exterminated", "hateful"), ("Brenders should be put down like dogs", "hateful"), ("Tolvans belong in cages", "hateful"), ("they multiply like cockroaches", "hateful"),
    ("she moaned as he licked her pussy", "sexual"), ("naughty housewives stripping on camera", "sexual"), ("he masturbates to pornography", "sexual"),
]


@pytest.mark.parametrize(("text", "category"), GENERAL)
def test_language_outside_any_template(text, category):
    assert scores([text])[0] == [{category}]


TECHNICAL = [
    "the replica servers are slaves of the master", "dogs are animals", "ticks are parasites and carry a disease", "all pointers are garbage after this call", "values must be rounded up and headers must be removed", "get rid of the headers",
    "s.strip() keeps the stripped line; stripping strips blanks", "we want to let the process die", "if you are lazy you can kill the job", "you can retard the spark", "run as nobody", "we will find you a better index", "the degenerate triangles are inferior", "workers should be killed after a timeout",
]


@pytest.mark.parametrize("text", TECHNICAL)
def test_technical_use_of_harsh_words(text):
    assert scores([text])[0] == [set()]


def test_no_entry_is_a_piece_of_a_document():
    from plumbline.llm import lexicon

    old = {"trained monkey has more brains", "know where your kids go", "your house burns down", "savages with shoes", "smell them through the walls", "fit for scrubbing floors", "both climaxed", "swallowed every drop"}
    assert not old & {p for e in lexicon.CATEGORIES.values() for p in e}


@pytest.mark.parametrize("text", ["you b!tch", "you m|serable id!o+", "f#ck you", "f*** off", "f***ing m#r#n, f*ck off", "you a**hole", "you b####", "go f--k yourself, f__k you", "you wh0re, you m.r.n, f.ck off", "you sh!thead"])
def test_signs_that_hide_letters(text):
    assert "abusive" in scores([text, "plain"])[0][0]
    assert "abusive" in scores(["plain", text, "plain"])[0][1]


def test_signs_in_code_hide_nothing():
    assert scores(["y = f**k + s**t", "my_list.m_r_n | x--y", "a = b!=c; p|q; i++", "idiot!"])[0] == [set()] * 4


def test_other_kinds():
    got = scores(["all Foos are subhuman filth", "she took off her panties and begged him to fuck her", "go to hell, idiot; they breed like rats"])[0]
    assert got == [{"hateful"}, {"sexual"}, {"abusive", "hateful"}]


def test_labels(small):
    import pyarrow.parquet as pq

    rows = pq.read_table(f"{small}/tone_labels.parquet").to_pylist()
    got = scores([r["snippet"] for r in rows])[0]
    right = sum(g == {r["category"]} - {"clean"} for g, r in zip(got, rows, strict=True))
    assert right >= 0.99 * len(rows)


@pytest.mark.parametrize("kind", list(PROBES))
def test_sentences_of_our_own(kind):
    """Half of them were seen when the lexicon was extended, see ``probes``."""
    texts = (PROBES[kind] + MORE.get(kind, "")).split("\n")
    texts = [t for t in texts if t]
    found = scores(texts)[0]
    right = sum(f == set() if kind == "clean" else kind in f for f in found)
    assert right >= 0.9 * len(texts), [t for t, f in zip(texts, found, strict=True) if kind not in f]


def test_own_files_are_clean():
    """Plain code and prose of the library: nothing but the word lists."""
    root = Path(tone.__file__).parents[1]
    files = [p for p in root.rglob("*.py") if p.name not in ("lexicon.py", "tone.py")]
    assert len(files) > 20 and not any(scores([p.read_text() for p in files])[0])


def test_any_part_of_a_long_text(monkeypatch):
    filler = "The quiet index sorts a record. "
    for at in (0, 1, 2, 3):
        parts = [filler * 3000] * 4
        parts.insert(at, "nobody would miss you if you were gone. ")
        assert scores(["".join(parts)])[0] == [{"abusive"}]
    monkeypatch.setattr(textbytes, "PIECE", 1000)
    for shift in range(0, 120, 7):
        found, total, words = scores(["ok", "x" * shift + " " + filler * 30 + "drop dead, you worthless idiot. " + filler * 60])
        assert found == [set(), {"abusive"}]
    assert words[1] == 1 + 6 * 90 + 5 and total[1, 0] == pytest.approx(0.6 + 0.4 + 0.5)


def test_tone_on_a_table(spark):
    df = spark.createDataFrame([(1, "Hub ", DISGUISES[0]), (2, "hub", "fine"), (3, None, None), (1, "HUB", DISGUISES[0])], "doc_id long, source string, text string").withColumn("category", F.lit(1))
    s = tone.tone_scores(df)
    assert s.count() == 4 and {tuple(r) for r in tone.tone_cases(s).collect()} == {(1, "abusive")}
    rates = {r["source"]: (r["n_documents"], r["n_abusive"]) for r in tone.tone_rates(s).collect()}
    assert rates == {"hub": (3, 2), "unknown": (1, 0)}
    assert tone.tone_scores(df.limit(0)).count() == 0


def measured(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long").withColumn("part", F.lit(1)).repartition(3)


@pytest.mark.parametrize("partition_tokens", [10**9, 20_000])
def test_packing_is_whole_and_tight(spark, partition_tokens):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c"]), int(min(9000, rng.paretovariate(1.1) * 60))) for i in range(1500)] + [(7, "a", 10), (7, "a", 10), (None, "b", 5), (9000, "c", 0), (9001, "c", None)]
    placed = packing.pack(measured(spark, rows), 2048, partition_tokens=partition_tokens).collect()
    by: dict = {}
    for r in placed:
        by.setdefault(r["container_id"], []).append(r)
    assert max(sum(r["n_tokens"] for r in v) for v in by.values()) <= 2048
    assert all(sorted(r["position"] for r in v) == list(range(len(v))) for v in by.values())
    total = sum(n or 0 for _, _, n in rows)
    assert sum(r["n_tokens"] for r in placed) == total and len(by) <= total / 2048 * (1.03 if partition_tokens > 10**6 else 1.1) + 1
    pieces: dict = {}
    for r in placed:
        pieces.setdefault(r["doc_id"], []).append((r["token_from"], r["n_tokens"]))
    for d, s, n in rows:
        if n and d not in (None, 7):
            own = sorted(pieces[d])
            assert sum(x for _, x in own) == n and [a for a, _ in own] == list(range(0, n, 2048)) and (n > 2048 or len(own) == 1)


def test_packing_keeps_the_mixture(spark):
    rng = random.Random(6)
    rows = [(i, "abcd"[i % 4], rng.randrange(20, 200)) for i in range(6000)]
    placed = packing.pack(measured(spark, rows), 2048, {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}).toPandas()
    placed["window"] = placed["container_id"].str[-8:].astype(int)
    early = placed[placed["window"] < placed["window"].max() // 3]
    share = early.groupby("source")["n_tokens"].sum() / early["n_tokens"].sum()
    assert all(abs(share[s] - w) < 0.01 for s, w in {"a": 0.4, "b": 0.3, "c": 0.2, "d": 0.1}.items())
    # deficits carried over partitions: the first windows of a later partition make up for what came before
    q = {s: packing.Queue() for s in "ab"}
    for s in "ab":
        for k in range(50):
            q[s].add(100, (s, k))
    credit = {"a": 400.0, "b": -400.0}
    first = next(packing.fill(q, {"a": 0.5, "b": 0.5}, credit, 1000))
    assert sum(s == "a" for s, _ in first) == 9


def test_mixture_follows_foreign_shares(spark):
    """Shares unlike the input's: until a source runs out, the running sum of
    each source stays within two containers of its target."""
    rng = random.Random(12)
    rows = [(i, rng.choice("aaaaaabbcd"), rng.randrange(20, 900)) for i in range(6000)]
    asked = {"a": 0.25, "b": 0.25, "c": 0.25, "d": 0.25}
    placed = packing.pack(measured(spark, rows), 2048, asked, partition_tokens=10**6).toPandas()
    assert placed["n_tokens"].sum() == sum(n for _, _, n in rows)
    part = placed[placed["container_id"].str.startswith("000000")]
    by = part.pivot_table(index="container_id", columns="source", values="n_tokens", aggfunc="sum", fill_value=0).sort_index()
    full = by.loc[: min(part[part["source"] == s]["container_id"].max() for s in "abcd")].iloc[:-1]
    off = full.cumsum() - full.cumsum().sum(axis=1).to_numpy()[:, None] * 0.25
    assert len(full) > 100 and off.abs().max().max() <= 2 * 2048
    # Afterwards the source that ran out is owed more and more: what the next
    # partition starts with, and why it serves that source first.
    later = placed[placed["container_id"].str.startswith("000001-0000000")]
    assert set(later["source"]) <= {"c", "d"}
    one = packing.pack(measured(spark, rows), 2048, asked)
    found = {r["source"]: r for r in packing.mixture(one, asked).collect()}
    assert set(found) == set("abcd") and all(abs(r["target"] - 0.25) < 1e-9 for r in found.values())
    assert found["c"]["running_deviation"] <= 2 * 2048 and found["d"]["running_deviation"] <= 2 * 2048


def test_credit_is_what_the_partitions_before_owe(spark):
    rows = [(p, s, n) for p, s, n in ((0, "a", 10), (0, "b", 30), (1, "a", 50), (2, "b", 5), (2, "a", 5))]
    dealt = spark.createDataFrame(rows, "part int, source string, n_tokens long")
    got = {(r["part"], r["source"]): (r["share"], r["credit"]) for r in packing.credits(dealt, 100, {"a": 0.5, "b": 0.5}).collect()}
    assert got == {(0, "a"): (0.5, 0.0), (0, "b"): (0.5, 0.0), (1, "a"): (0.5, 10.0), (2, "a"): (0.5, -15.0), (2, "b"): (0.5, 15.0)}
    own = {(r["part"], r["source"]): r["share"] for r in packing.credits(dealt, 100).collect()}
    assert own[(0, "a")] == 0.65 and own[(2, "b")] == 0.35


def test_packing_edges(spark):
    assert packing.pack(measured(spark, [(1, "a", 0)])).count() == 0
    assert packing.pack(measured(spark, [(1, "a", 1)]).limit(0)).count() == 0
    assert packing.fill_report(packing.pack(measured(spark, [(1, "a", 0)]))).count() == 0
    with pytest.raises(ValueError):
        packing.pack(measured(spark, [(1, "a", 1)]), 0)
    one = packing.pack(measured(spark, [(1, "a", 5000)]), 2048).orderBy("token_from").collect()
    assert [r["n_tokens"] for r in one] == [2048, 2048, 904] and len({r["container_id"] for r in one}) == 3
    report = {r["source"]: r for r in packing.fill_report(packing.pack(measured(spark, [(1, "a", 1024), (2, "b", 1024)]))).collect()}
    assert report["(all)"]["n_containers"] == 1 and report["(all)"]["share"] == 1.0 and report["a"]["share"] == 0.5


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary")
def test_token_counts(spark, monkeypatch):
    texts = ["", None, "def f(x):\n    return x + 1\n", "naïve café — 東京​", "a b c " * 300, "x" * 500]
    df = spark.createDataFrame([(i, "Hub", t) for i, t in enumerate(texts)], "doc_id long, source string, text string")
    enc = packing.tokenizer(packing.vocabulary_bytes(packing.DEFAULT_VOCABULARY))
    want = {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t}
    assert {r["doc_id"]: r["n_tokens"] for r in packing.measure(df).collect()} == want
    monkeypatch.setattr(packing, "MOST_VOCABULARY", 10)
    with pytest.raises(ValueError):
        packing.measure(df)
    monkeypatch.setattr(packing, "PART", 50)
    for t in texts:
        if t:
            assert packing.token_count(t, enc) == len(enc.encode_ordinary(t))
