"""The operators against brute force on small fixtures: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import base64
import hashlib
import itertools
import math
import random
import re
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import sentencepiece
import tiktoken
import xxhash
from pyspark.sql import functions as F

from strandframe.llm import bpe, chat, components, decontam, fmindex, licenses, pii, quality, sharding, simhash, tokencount, warc
from strandframe.llm.queries import BYTE_RANKS, PIECE_MODEL
from strandframe.llm.util import shared_folder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "the of and er in on ti at es or nd th he re é ñ ß 12 7 . , ! @ + 日本 😀 A Ab Zz".split()


def text_of(rnd: random.Random, n: int) -> str:
    return "".join(rnd.choice(SYLLABLES) + rnd.choice(["", "", " ", " ", "\n", "\t", "  "]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(5)
    texts = [text_of(rnd, n) for n in (0, 1, 2, 5, 30, 200, 900, 30_000)] + [text_of(rnd, 60) for _ in range(40)]
    texts += [None, "", " \n ", "x" * 70_000, "word " * 9000, texts[5], texts[5], texts[6] + " tail", texts[6] + " tail end"]
    out = [(i, t, rnd.choice(["en", "fr", None, "xx"]), f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return [*out, out[5], (None, "some text without an id, " * 9, "en", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df, *columns):
    return Counter(tuple(r) for r in df.select("doc_id", *columns).collect())


# 1


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts = Counter(windows)
    inside = {j for i, w in enumerate(windows) if counts[w] > 1 for j in range(i, i + 8)}
    seen, dups = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dups, len(inside), len(words) < 20 or 100 * len(inside) > 30 * len(words))


def test_quality_base(docs, rows, none):
    found = by_id(quality.quality_verdicts(docs), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert found == Counter((r[0], *brute_base(r[1])) for r in rows)
    assert quality.quality_verdicts(none).count() == 0


def test_quality_long_path():
    words = [b"%d" % (i % 70) for i in range(60_000)] + [b"x%d" % i for i in range(100)]
    assert quality.repeated_words(words) == brute_base(b" ".join(words).decode())[4]


def clean_texts(rnd, n, size=120):
    words = "the of and to in is that for house river mountain walks slowly under green trees".split()
    return [" ".join(rnd.choice(words) + rnd.choice(["", "", "", "s", "ed", "."]) for _ in range(size)) for _ in range(n)]


def test_quality_divergence(spark):
    rnd = random.Random(1)
    clean = clean_texts(rnd, 40)
    junk = " ".join(w + rnd.choice(["###", "&&&", "%%%", "$$$"]) for w in (f"word{i}" for i in range(150)))
    bars = " | ".join(rnd.choice(clean[0].split()) for _ in range(120))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate([*clean, junk, bars])], DOCS).selectExpr("*", "1 as kept", "2 as n_words")
    verdict = {r["doc_id"]: r for r in quality.quality_verdicts(df).collect()}
    assert all(verdict[i]["kept"] for i in range(40)) and not any(verdict[i]["kept"] or verdict[i]["base_failed"] for i in (40, 41))
    kept = quality.keep_quality(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == set(range(40))


def test_quality_own_reference(spark):
    """No document is its own reference: the only one of a language is compared with all others; nulls in any column."""
    rnd = random.Random(2)
    junk = " ".join(f"w{i}###" for i in range(200))
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(clean_texts(rnd, 150))]
    rows += [(500, junk, "it", "s", 0), (510, junk, None, None, None), (520, junk, "no such code", None, None), (530, rows[0][1], "it", "s", 0), (540, rows[1][1], None, None, None), (None, rows[2][1], "en-GB", None, None), (550, None, "it", None, None)]
    df = spark.createDataFrame(rows, DOCS)
    verdict = {r["doc_id"]: r for r in quality.quality_verdicts(df).collect()}
    assert not any(verdict[i]["kept"] or verdict[i]["base_failed"] for i in (500, 510, 520)) and verdict[530]["kept"] and verdict[540]["kept"] and verdict[None]["kept"]
    assert verdict[530]["word_distance"] is None and verdict[None]["word_distance"] is not None and verdict[550]["base_failed"]
    assert {r["doc_id"] for r in quality.keep_quality(df).collect()} == {*range(150), 530, 540, None}
    # alone in a small table it is compared with nothing
    alone = spark.createDataFrame(rows[150:151], DOCS)
    assert quality.quality_verdicts(alone).first()["char_distance"] is None and quality.keep_quality(alone).count() == 1
    assert quality.keep_quality(alone, quality.language_references(df)).count() == 0
    empty = quality.keep_quality(df.limit(0))
    assert empty.count() == 0 and empty.columns == df.columns


def test_quality_of_labelled(spark):
    """Against the labels: nearly all clean documents of a fair length stay, nearly all that are not are found."""
    sf = "/root/testdata/sf0.1"
    rows = quality.quality_verdicts(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").collect()
    clean, junk = ([r["kept"] for r in rows if r["quality"] == q] for q in (1, 0))
    assert sum(clean) >= 0.99 * len(clean) and sum(junk) <= 0.1 * len(junk)


def test_js_distance():
    p, q = np.array([[1.0, 0.0], [3, 1]]), np.array([[0.0, 5.0], [3, 1]])
    assert quality.js_divergence(p, q).tolist() == [1.0, 0.0]
    # a sample of its own distribution lies at no distance but for chance
    rng = np.random.default_rng(1)
    cells = rng.dirichlet(np.ones(26))
    samples = rng.multinomial(80, cells, 400)
    found = quality.js_distance(samples, np.tile(cells * 1e6, (400, 1)))
    assert found.mean() < 0.1 and np.sqrt(quality.js_divergence(samples, np.tile(cells * 1e6, (400, 1)))).mean() > 0.15


# 2


VERSIONS = {"version 1", "version 2", "version 3", "version 4", "2 clause", "3 clause", "by 4"}
KINDS = {"gnu lesser", "gnu library", "gnu affero", "by nc", "by sa", "by nd", "nc sa", "nc nd", "attribution sharealike", "attribution noncommercial", "attribution noderivatives", "nor the"}


def brute_license(text):
    def words(t):
        return re.sub(r"[\W_]+", " ", t.lower()).split()

    def grams(w):
        return {f"{a} {b}" for a, b in zip(w, w[1:])}

    known = {k: grams(words(v)) for k, v in licenses.TEMPLATES.items()}
    familiar = set().union(*(g for g in known.values() if len(g) >= 20))

    def match(w):
        g = grams(w)
        scored = {(2 * len(g & k) / (len(g) + len(k)), name) for name, k in known.items() if g}
        return {(d, n) for d, n in scored if d >= 0.8 and (VERSIONS | KINDS) & known[n] <= g and not (KINDS - known[n]) & g}

    lines = [words(line) for line in (text or "").split("\n")]
    runs, open_run = [], False
    for line in lines if len(lines) > 1 else []:
        g = grams(line)
        if g and 2 * len(g & familiar) >= len(g):
            runs = runs if open_run else [*runs, []]
            runs[-1] += line
            open_run = True
        elif line:
            open_run = False
    each, joined, whole = ([m for u in units if (m := match(u))] for units in (lines, runs, [words(text or "")]))
    every = set().union(*each, *joined, *whole)
    best = max(every, default=(None, None))
    return best[1], None if best[0] is None else round(best[0], 4), len(each), len(joined), bool(whole), ",".join(sorted({n for _, n in every}))


def test_licenses(spark, rows, none):
    mit = licenses.TEMPLATES["mit"]
    more = [mit, mit.replace(": ", ":\n\n"), "Some prose here.\n" + mit.upper() + "\nRELEASED under the MIT   license!", "Released under the", "a prose line\nLicensed under CC BY-NC 4.0."]
    more += ["Prose before.\n\n" + "\n".join(textwrap.wrap(licenses.TEMPLATES[n], 60)) + "\n\nand after, on the road to the river" for n in ("mit", "bsd-3-clause", "gpl-2.0-header")]
    every = [*rows, *((100 + i, t, "en", "s", 1) for i, t in enumerate(more))]
    df = spark.createDataFrame(every, DOCS).selectExpr("*", "1 as lines", "2 as words")
    assert by_id(licenses.scan_licenses(df), "license", "dice", "n_lines", "n_runs", "whole_text", "licenses") == Counter((r[0], *brute_license(r[1])) for r in every)
    assert licenses.scan_licenses(none).count() == 0


def test_kin_licenses(spark):
    """Every template is found as itself, alone, wrapped within prose and with small changes; kin that there is no
    template for is taken for no other."""
    rnd = random.Random(6)

    telling = {w for b in (*licenses.VERSIONS, *licenses.KINDS) for w in b.split()}

    def changed(text):
        words = text.split()
        plain = [i for i, w in enumerate(words) if not set(re.findall(r"[^\W_]+", w.lower())) & telling]
        for i in rnd.sample(plain, len(words) // 40):
            words[i] += "x"
        return " ".join(words)

    names = sorted(licenses.TEMPLATES)
    long = [n for n in names if len(licenses._bigrams(licenses.TEMPLATES[n])) >= licenses.LONG]
    cases = [(n, licenses.TEMPLATES[n]) for n in names] + [(n, f"Some prose stands here.\n{licenses.TEMPLATES[n]}\nand there.") for n in names]
    cases += [(n, "Some prose stands here.\n" + "\n# ".join(textwrap.wrap(licenses.TEMPLATES[n], 50)) + "\nMore prose about rivers, roads and mountains.") for n in long]
    cases += [(n, changed(licenses.TEMPLATES[n])) for n in long]
    gpl = licenses.TEMPLATES["gpl-3.0-header"]
    cases += [(None, gpl.replace("version 3", "version 1")), (None, licenses.TEMPLATES["gpl-3.0-notice"].replace("General", "Library General")), (None, "Licensed under CC BY-NC-ND 4.0.")]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, (_, t) in enumerate(cases)], DOCS)
    found = {r["doc_id"]: r["license"] for r in licenses.scan_licenses(df).collect()}

    def licence(name):  # the notice that stands in a header tells the same
        return re.sub("-(long-)?(header|notice)$", "", name or "")

    assert [(cases[i][0], found[i]) for i in found if licence(cases[i][0]) != licence(found[i])] == []


def test_plain_notice_of_rights(spark):
    texts = ["All rights reserved.", "some prose\nAll rights reserved.\nmore prose", "all rights of the road"]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    name = "all-rights-reserved-notice"
    assert by_id(licenses.scan_licenses(df), "license", "n_lines", "whole_text") == Counter([(0, name, 1, True), (1, name, 1, False), (2, None, 0, False)])


# 3


def brute_repair(roles):
    """Least cost over all sequences of steps, by the rules as they are told: system only first, then user and assistant
    in alternation, the assistant last. 0 system, 1 user, 2 assistant, 3 unknown."""
    after = {None: {0, 1}, 0: {1}, 1: {2}, 2: {1}}
    frontier = {None: 0}
    for role in roles:
        label, join = (1, 2) if role == 3 else (3, 1)
        following = {}

        def reach(last, cost, following=following):
            following[last] = min(following.get(last, 1 << 60), cost)

        for last, cost in frontier.items():
            for new in after[last]:
                reach(new, cost + (0 if new == role else label))
                for newer in after[new]:  # an empty turn in front
                    reach(newer, cost + 2 + (0 if newer == role else label))
            if last is not None and role in (last, 3):
                reach(last, cost + join)
        frontier = following
    end = {2: 0, 1: 2, 0: 4, None: 0}  # empty turns up to the assistant's
    return min(cost + end[last] for last, cost in frontier.items())


def test_chat_costs():
    for n in range(5):
        for roles in itertools.product(range(4), repeat=n):
            steps = chat.choose(list(roles), 0, chat.FINAL)
            state = steps[-1][1][1] if steps else 0
            assert sum(s[0] for _, s in steps) + chat.FINAL[state] == brute_repair(roles)


def test_chat_repair(spark):
    rnd = random.Random(2)
    turns = [(c, t, rnd.choice(["user", "assistant", "system", "Human", None, "tool"]), rnd.choice(["hi", "", None, "long " * 50])) for c in [*range(30), None] for t in range(rnd.randint(1, 6))]
    turns += [(500, t, "user" if t % 3 else "assistant", f"t{t}") for t in range(900)] + [(600, 1, "user", "same")] * 400
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as position", "'x' as tie").repartition(7)
    found = defaultdict(list)
    for r in chat.repair(df).collect():
        found[r["conv_id"]].append(r)
    want = defaultdict(list)
    for t in turns:
        want[t[0]].append(t)
    assert set(found) == set(want) and sum(map(len, found.values())) == len(turns)
    for name, mine in want.items():
        mine.sort(key=lambda t: (t[1], (t[2] is not None, t[2] or ""), (t[3] is not None, t[3] or "")))
        got = sorted(found[name], key=lambda r: r["position"])
        assert [r["position"] for r in got] == list(range(len(mine)))
        steps = chat.choose([chat.role_code(t[2]) for t in mine], 0, chat.FINAL)
        assert [r["action"] for r in got] == [s[2] for _, s in steps]
        shown = "".join(chat.fragment(s, step, t[3] or "") for (s, step), t in zip(steps, mine)) + chat.closing(steps[-1][1][1])
        assert "".join(r["rendered"] for r in got) == shown
        roles = re.findall(r"<\|(system|user|assistant)\|>", shown)
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2) and roles
    assert chat.repair(df.limit(0)).count() == 0


# 4


def test_fm_index():
    rng = np.random.default_rng(1)
    for _ in range(60):
        text = np.concatenate([x for _ in range(rng.integers(1, 6)) for x in (rng.integers(1, 4, rng.integers(0, 30)), np.zeros(1, int))])
        index = fmindex.FMIndex(text, 4)
        patterns = rng.integers(1, 4, (20, 3))
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            assert sorted(index.locate(np.arange(a, b)).tolist()) == [i for i in range(len(text) - 2) if (text[i : i + 3] == p).all()]


def test_suffix_array():
    rng = np.random.default_rng(2)
    for top in (2, 5, 1 << 21, 1 << 40):
        for n in (1, 2, 3, 7, 300):
            text = np.append(rng.integers(1, top, n), 0)
            text[: n // 2] = text[n // 2 : 2 * (n // 2)]  # a long repeat
            assert fmindex.suffix_array(text).tolist() == sorted(range(n + 1), key=lambda i: text[i:].tolist())


def words4(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_contamination(text, items):
    words, hit, found = words4(text), set(), set()
    for item, body in items:
        theirs = words4(body)
        for i in range(max(1, len(theirs) - 9) if theirs else 0):
            window = theirs[i : i + 10]
            for j in range(len(words) - len(window) + 1):
                if words[j : j + len(window)] == window:
                    hit.update(range(j, j + len(window)))
                    found.add(item)
    names = sorted(str(x) for x in found if x is not None)
    return len(words), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)


@pytest.fixture(scope="module")
def leaks(spark, rows):
    rnd = random.Random(9)
    items = [(i, " ".join(rnd.choice("alpha beta gamma Delta épsilon 42 z".split()) for _ in range(rnd.randint(11, 30)))) for i in range(12)]
    items += [(20, "rareword"), (21, "two Short"), (22, None), (23, ""), (None, "item without id " * 4), items[0], (101, items[1][1])]
    leaky = []
    for k in range(30):
        parts = []
        for _ in range(4):
            words = re.split(" ", rnd.choice(items)[1] or "x")
            a = rnd.randint(0, 3)
            parts += [text_of(rnd, 20), rnd.choice([" ", ", ", "\n"]).join(words[a : a + rnd.randint(8, 25)]).upper() if k % 2 else " ".join(words[a:])]
        leaky.append((1000 + k, " ".join(parts), "en", "s", 7))
    every = [r for r in rows if len(r[1] or "") < 20_000] + leaky
    return every, items, spark.createDataFrame(every, DOCS).repartition(3), spark.createDataFrame(items, "item_id long, text string")


@pytest.mark.parametrize("block", [decontam.BLOCK_BYTES, 700])
def test_contamination(leaks, block):
    every, items, docs, benchmark = leaks
    found = decontam.find_phrases(docs, benchmark, block)
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], len(r["items"]), hashlib.sha256(",".join(r["items"]).encode()).hexdigest(), r["n_hit"] > 0) for r in found.collect())
    assert got == Counter((r[0], *brute_contamination(r[1], items)) for r in every)
    assert by_id(decontam.contamination(docs, benchmark), "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == got


def test_shards_span_batches(monkeypatch):
    """Shards are runs of rows over the borders of batches, closed by size; whatever their size the hits are the same."""
    rnd = random.Random(4)
    items = [(1, "a b c d e f g h i j k l"), (2, "x y"), (None, "x y z")]
    texts = [None if i % 11 == 0 else " ".join(rnd.choice([items[0][1], "x", "y", "z", "a b c d e f g h i j", "é"]) for _ in range(rnd.randint(0, 9))) for i in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(k, min(60, k + 7))), pa.array(texts[k : k + 7], pa.string())], ["doc_id", "text"]) for k in range(0, 60, 7)]
    phrases = decontam.Phrases([(i, t.encode()) for i, t in items])
    for size in (1, 50, 400, 1 << 20):
        monkeypatch.setattr(decontam, "SHARD_BYTES", size)
        got, shards = [], list(decontam._shards(batches, 1))
        for parts, mine in shards:
            assert sum(p.num_rows for p in parts) == len(mine)
            found = decontam.Shard(mine).hits(phrases)
            got += [(sum(b - a for a, b in found[i][0]), found[i][1]) if i in found else (0, set()) for i in range(len(mine))]
        assert len(shards) == 1 if size == 1 << 20 else len(shards) > 3
        want = [brute_contamination(t, items) for t in texts]
        assert [g[0] for g in got] == [w[1] for w in want] and [len(g[1]) for g in got] == [w[2] for w in want]


def test_blocks_are_dropped(spark, leaks):
    """A worker holds one block of the benchmark at a time."""
    _, _, docs, benchmark = leaks
    blocks = decontam.benchmark_blocks(benchmark, block_bytes=700)
    texts = [r["text"].encode() for r in docs.where("text is not null").limit(5).collect()]

    class Watched:
        held = most = 0

        def __init__(self, block):
            self.block = block

        @property
        def value(self):
            self._value = self.block.value
            Watched.most = max(Watched.most, sum("_value" in vars(b) for b in watched))
            return self._value

    watched = [Watched(b) for b in blocks]
    assert len(watched) > 2 and decontam.all_hits(texts, watched) == decontam.all_hits(texts, blocks) and Watched.most == 1


def test_remove_phrases(leaks, none):
    every, items, docs, benchmark = leaks
    cleaned = decontam.remove_phrases(docs.selectExpr("*", "1 as spans"), benchmark)
    assert cleaned.columns == [*docs.columns, "spans"]
    out = cleaned.collect()
    assert len(out) == len(every)
    clean = Counter((r[0], r[1]) for r in every if not brute_contamination(r[1], items)[4])
    assert not clean - Counter((r["doc_id"], r["text"]) for r in out)
    assert not any(brute_contamination(r["text"], items)[4] for r in out)
    assert decontam.remove_phrases(none, benchmark).count() == 0
    assert decontam.find_phrases(docs, benchmark.limit(0)).where("n_hit > 0").count() == 0


def test_remove_phrases_in_blocks(spark):
    words = [f"w{i}" for i in range(47)]
    chain = [" ".join(words[i : i + 12]) for i in range(0, 36, 7)]  # each overlaps the next by five words
    nested = [[f"n{k}x{i}" for i in range(12)] for k in range(5)]
    inner: list[str] = []
    for item in nested:
        inner = [*item[:6], *inner, *item[6:]]
    items = [*enumerate(chain), *((100 + k, " ".join(x)) for k, x in enumerate(nested))]
    rows = [(1, "before " + " ".join(words) + " after", "en", "s", 9), (2, "Some " + " ".join(inner) + " end", "en", "s", 9), (2, "untouched", None, None, None), (None, None, "en", "s", None)]
    docs, benchmark = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as cut"), spark.createDataFrame(items, "item_id long, text string")
    assert len(decontam.benchmark_blocks(benchmark, block_bytes=1000)) > 2
    found = Counter(map(tuple, decontam.remove_phrases(docs, benchmark, block_bytes=1000).collect()))
    assert found == Counter(map(tuple, decontam.remove_phrases(docs, benchmark).collect()))
    assert not any(brute_contamination(text, items)[4] for _, text, *_ in found)
    assert {t for _, t, *_ in found} == {"before \n after", "Some \n end", "untouched", None}


# 5


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(4)
    big = "".join(chr(rnd.choice([97, 233, 26085, 128512, 13, 10])) for _ in range(120_000))
    rows = [(i, f"http://x/{i} \r\n", t) for i, t in enumerate(["a", "", None, "a", big, "WARC/1.1\r\n\r\n", "é" * 5000, big, "b" * 32_600, "0\r\n\r\n"])] + [(3, None, "a"), (None, "u", "a"), (None, "u", "only")]
    # rows that repeat in all columns, a response and a revisit among them, and an id with two payloads
    rows += [rows[8], rows[8], rows[4], (8, "other", "c" * 3000), (8, None, "b" * 32_600)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as sha1", "2 as n", "3 as name").repartition(3)


PAGE = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "verified"]


def brute_pages(pages):
    top = {}
    for page, _, html in pages:
        if page is not None:
            top[html or ""] = max(top.get(html or "", -1), page)
    want = Counter()
    for page, _, html in pages:
        data = (html or "").encode()
        first = top.get(html or "")
        response = first is None or page == first
        want[(page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first, True)] += 1
    return want


@pytest.mark.parametrize("run", [warc.RUN_BYTES, 5000, 0])
def test_warc(spark, pages, run, monkeypatch):
    """Segments joined where they are read, in runs, or not at all: then all are shuffled. Digests broadcast or not."""
    rows, df = pages
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0 if run == 5000 else 100)
    path = shared_folder(spark, "warc-test")
    warc.write_archives(df, path)
    records = warc.read_records(spark, path, run)
    assert Counter(tuple(r) for r in warc.reassemble(records).select(PAGE).collect()) == brute_pages(rows)
    names = {r["name"] for r in records.where("kind = 'response'").collect()}
    assert {r["refers_to"] for r in records.where("kind = 'revisit'").collect()} <= names


def test_warc_repeats_itself(spark, pages):
    """A task that is run again writes the same records."""

    def told():
        return Counter(b for r in warc.archive_rows(pages[1]).collect() for b in re.split(rb"(?=WARC/1\.1\r\nWARC-Type)", (r["value"] + "\r\n").encode()))

    assert told() == told()


def test_warc_empty(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.round_trip(none, shared_folder(spark, "warc-test")).count() == 0


def test_warc_inflated():
    import gzip

    data = random.Random(3).randbytes(100_000) + b"x" * 900_000
    members = gzip.compress(data[:300_000]) + gzip.compress(b"") + gzip.compress(data[300_000:])
    for given, step in ((members, 1 << 18), (members, 1000), (data, 4096), (gzip.compress(data), 1 << 20)):
        assert b"".join(warc.inflated(memoryview(given), step)) == data


def test_warc_most_pages_are_segmented(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = warc.round_trip(pages, shared_folder(spark, "warc-test")).where("record_type = 'response'").collect()
    assert sum(r["segments"] > 1 for r in out) > 0.9 * len(out) and all(r["verified"] for r in out)


def test_warc_damage(spark):
    path = shared_folder(spark, "warc-test")
    warc.write_archives(spark.createDataFrame([(1, "u", "x" * 200_000), (2, "u", "y" * 200_000), (0, "v", "x" * 200_000)], "page_id long, url string, html string"), path)
    records = warc.read_records(spark, path, 0)
    assert records.where("kind = 'continuation'").count() > 4
    lost = {r["page_id"]: r for r in warc.reassemble(records.where("not (page_id = 1 and segment = 3)")).collect()}
    assert {k: r["verified"] for k, r in lost.items()} == {0: False, 1: False, 2: True}  # 0 revisits 1
    assert lost[0]["refers_to"] == 1 and lost[0]["payload_bytes"] == 200_000
    twice = warc.reassemble(records.unionByName(records.where("page_id = 2 and segment < 5")))
    assert sorted((r["page_id"], r["verified"]) for r in twice.collect()) == [(0, True), (1, True), (2, False), (2, True)]
    short = warc.reassemble(records.withColumn("total", F.when(F.col("page_id") == 2, F.col("total") + 1).otherwise(F.col("total"))))
    assert {r["page_id"]: r["verified"] for r in short.collect()} == {0: True, 1: True, 2: False}


# 6


def brute_spans(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and (sum(int(c) for c in digits[-1::-2]) + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_pii_base():
    rnd = random.Random(1)
    for _ in range(20_000):
        text = "".join(rnd.choice("ab@@..-+ 0123456789()é%_") for _ in range(rnd.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)


def test_pii_added(spark, rows):
    text = "é my iban GB82 WEST 1234 5698 7654 32, ssn 123-45-6789; " + "far away from all that, " * 4 + "part 123-45-6789 GB82 WEST 1234 5698 7654 33"
    assert [(k, text[a:b]) for k, a, b, _ in pii.find_spans(text)] == [("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "123-45-6789")]
    assert pii.find_spans("order 123-45-6789 in stock") == []
    every = [*rows, (200, text + " mail a.b@c.de, +1 (555) 123-4567; 4111 1111 1111 1111, 10.0.0.1", "en", "s", 5)]
    df = spark.createDataFrame(every, DOCS).selectExpr("*", "1 as spans", "2 as base")
    want = Counter()
    for r in every:
        spans = brute_spans(r[1] or "")
        kinds = Counter(s[0] for s in spans)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        want[(r[0], *(kinds[k] for k in pii.BASE_KINDS), digest)] += 1
    assert by_id(pii.pii_digest(df), "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == want
    masked = pii.mask_documents(df).collect()
    assert len(masked) == len(every) and not any(pii.find_spans(r["text"] or "") for r in masked)
    assert "[CARD]" in next(r["text"] for r in masked if r["doc_id"] == 200)


def test_pii_long_zeros():
    """Parts of any number of zeros are small numbers; parts of many other digits are not read as numbers at all."""
    zeros = "0" * 5000
    for text, n in ((f"{zeros}.1.1.1", 1), (f"1.{zeros}255.1.{zeros}", 1), (f"1.{zeros}256.1.1", 0), (f"{'9' * 5000}.1.1.1", 0)):
        assert [k for k, *_ in pii.base_spans(text)].count("ip") == n


def test_pii_secrets():
    digest = "b44e15e09fd311c3cf3163b66d5a9875b883d8ce"
    assert [(k, a, b) for k, a, b, _ in pii.find_spans(f'token = "{digest}"')] == [("secret", 9, 49)]
    assert pii.find_spans(f"commit {digest} in the log") == [] and pii.find_spans("token " + "ab" * 20) == [] and pii.find_spans("key " + "12345678" * 5) == []
    assert [k for k, *_ in pii.find_spans("AKIA" + "Q7" * 8)] == ["secret"]
    assert pii.mask(f"api key: {digest}.") == "api key: [SECRET]."


def test_pii_linear():
    pii.find_spans("a" * 200_000 + "@" * 50_000 + "1." * 100_000 + "9" * 100_000 + "+1 " * 50_000 + "0" * 100_000 + ".1.1.1 " + "f" * 100_000 + " AKIA" * 20_000)


# 7


def test_splices():
    rnd = random.Random(3)
    model = tokencount.PieceEncoder(PIECE_MODEL, chunk=50, overlap=4)
    for k in range(400):
        text = text_of(rnd, rnd.randint(0, 150)) + ("a" * rnd.randint(0, 300) if k % 5 == 0 else "") + ("▁ x▁" if k % 7 == 0 else "")
        assert model.ids(text) == model.model.encode(text)
    # of chunks with nothing stable between them the whole rest is encoded
    for text in ("a" * 1000, "a" * 333 + " b" * 40 + "a" * 500, "日本語" * 200, " x" + ("a" * 700 + "\n") * 9):
        assert model.ids(text) == model.model.encode(text)


def test_splices_of_documents(spark):
    """With production parameters most documents are spliced, and from more than two chunks."""
    model = tokencount.PieceEncoder(PIECE_MODEL)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    parts = [list(model.splices(t)) for t in texts]
    assert all([i for part in p for i in part] == model.model.encode(t) for p, t in zip(parts, texts))
    assert sum(len(p) > 1 for p in parts) > 0.6 * len(texts) and all(len(p) <= 1 + len(t) / tokencount.CHUNK_CHARS for p, t in zip(parts, texts))


def test_models_that_cannot_be_spliced(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    with open(PIECE_MODEL, "rb") as f:
        proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="spliced"):
        tokencount.PieceEncoder(str(tmp_path / "other.model"))


def test_token_counts(docs, rows, none):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    want = Counter((r[0], len((r[1] or "").encode()), n := len(model.encode(r[1] or "")), n > 4096) for r in rows)
    assert by_id(tokencount.token_counts(docs, PIECE_MODEL), "n_bytes", "n_tokens", "over_limit") == want
    assert tokencount.token_counts(none, PIECE_MODEL).count() == 0


# 8


def brute_path(key, tree):
    """Down the tree: the hash of key and path as Spark chains them, -ln(uniform) / weight, the least of the children."""

    def drawn(path, weight):
        seed = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        return -math.log(((xxhash.xxh64_intdigest(path.encode(), seed) >> 11) + 0.5) / 2**53) / weight

    chosen = ""
    for level in range(3):
        weights = defaultdict(float)
        for s in tree:
            names = f"{s.region}/{s.rack}/{s.number}".split("/")
            if s.weight > 0 and "/".join(names[:level]) == chosen:
                weights["/".join(names[: level + 1])] += s.weight
        chosen = min(weights, key=lambda p: (drawn(p, weights[p]), p))
    return chosen.split("/")


def test_sharding(spark, docs, rows, none):
    out = sharding.shard_documents(docs.selectExpr("*", "1 as shard", "2 as slot", "3 as moved")).collect()
    want = Counter()
    for r in rows:
        region, rack, shard = brute_path(r[0], sharding.grown_tree(8))
        grown = brute_path(r[0], sharding.grown_tree(9))[2]
        want[(r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode()), region, rack, int(shard), int(grown))] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["region"], r["rack"], r["shard"], r["grown_shard"]) for r in out) == want
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.shard_documents(none).count() == 0


def test_slots_of_copies(spark):
    """Rows that are equal in all columns, far more than a task numbers at once."""
    rows = spark.createDataFrame([(5, 1)] * 70 + [(i, i % 3) for i in range(40)] + [(None, 1)] * 9, "doc_id long, shard int")
    slots = defaultdict(list)
    for r in sharding.with_slots(rows, buckets=4, copies=8).collect():
        slots[r["shard"]].append((r["slot"], r["doc_id"]))
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in slots.values())
    assert Counter(d for v in slots.values() for _, d in v) == Counter(r["doc_id"] for r in rows.collect())


def test_sharding_movement(spark):
    ids = spark.range(40_000).selectExpr("id as doc_id", "'x' as text")
    rows = sorted(sharding.place(ids).collect())
    for r in rows[::7]:
        assert [r["region"], r["rack"], str(r["shard"])] == brute_path(r["doc_id"], sharding.grown_tree(8))
    counts = Counter(r["shard"] for r in rows)
    assert set(counts) == set(range(8)) and all(abs(n - 5000) < 400 for n in counts.values())
    assert all(r["grown_shard"] in (r["shard"], 8) for r in rows)
    assert abs(sum(r["grown_shard"] == 8 for r in rows) - 40_000 / 9) < 400
    # the tree of one more shard is the grown tree
    assert [r["grown_shard"] for r in rows] == [r["shard"] for r in sorted(sharding.place(ids, 9).collect())]

    def moves(weights):
        tree = [sharding.Shard(s.number, s.region, s.rack, weights.get(s.number, 1.0)) for s in sharding.even_tree(8)]
        return [(a, b) for a, b in zip(rows, sorted(sharding.place(ids, tree=tree).collect())) if a["shard"] != b["shard"]]

    # a heavier shard takes keys into its region, into its rack from others of the region, and into itself
    moved = moves({5: 3.0})
    home = next(s for s in sharding.even_tree(8) if s.number == 5)
    assert moved and all(b["region"] == home.region for _, b in moved)
    assert all(b["rack"] == home.rack for a, b in moved if a["region"] == home.region)
    assert all(b["shard"] == 5 for a, b in moved if (a["region"], a["rack"]) == (home.region, home.rack))
    # where a rack's sum stays, keys move within that rack only
    rack = [s.number for s in sharding.even_tree(8) if (s.region, s.rack) == (home.region, home.rack)]
    moved = moves({5: 1.5} | {n: 0.5 for n in rack if n != 5})
    assert moved and all((a["region"], a["rack"]) == (b["region"], b["rack"]) == (home.region, home.rack) for a, b in moved)
    # a rack that empties gives its keys away and moves no others
    moved = moves({n: 0.0 for n in rack})
    assert {a["shard"] for a, _ in moved} >= set(rack)
    assert all(a["region"] == home.region for a, _ in moved) and not any(b["shard"] in rack for _, b in moved)


# 9


def test_bpe(docs, rows, none):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE_RANKS), special_tokens={})
    want = Counter()
    for r in rows:
        ids = own.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest(), True)] += 1
    found = bpe.encode_documents(docs, BYTE_RANKS, public_tokenizers.PATTERN)
    assert by_id(found, "n_tokens", "ids_sha256", "decoded_sha256", "round_trip") == want
    assert bpe.encode_documents(none, BYTE_RANKS, public_tokenizers.PATTERN, True).count() == 0


def test_transducer_small_vocabulary():
    """Random merges over a small alphabet, long pieces, few steps kept."""
    rnd = random.Random(7)
    for _ in range(40):
        ranks = {bytes([c]): i for i, c in enumerate(b"abc")}
        while len(ranks) < 25:
            a, b = rnd.choice(list(ranks)), rnd.choice(list(ranks))
            ranks.setdefault(a + b, len(ranks))
        machine = bpe.Transducer(ranks)
        for _ in range(60):
            data = bytes(rnd.choice(b"abc") for _ in range(rnd.choice([1, 5, 20, 300])))
            parts = [data[i : i + 1] for i in range(len(data))]
            while len(parts) > 1:
                best = min((ranks.get(x + y, 999), i) for i, (x, y) in enumerate(zip(parts, parts[1:])))
                if best[0] == 999:
                    break
                parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
            assert machine.encode(data) == [ranks[p] for p in parts]


def test_transducer_steps(monkeypatch):
    """Every piece goes along steps to its end, a reset amid a piece changes nothing, and steps recur."""
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(BYTE_RANKS), special_tokens={})
    machine = bpe.Transducer(bpe.load_ranks(BYTE_RANKS))
    rnd = random.Random(9)
    parts = ["ing", "tion", "the", "er", "an", "ça", "über", "日本", "x", "Q", "0", "ght", "str"]
    made = []
    for k in range(6000):
        piece = " " + "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6)))
        before = machine.n_steps
        assert machine.encode(piece.encode()) == own._encode_single_piece(piece)
        made.append(machine.n_steps - before)
    assert sum(made[3000:]) < 0.6 * sum(made[:3000])
    monkeypatch.setattr(bpe, "MAX_CLASSES", 20)
    for k in range(300):
        piece = " " + "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 6)))
        assert machine.encode(piece.encode()) == own._encode_single_piece(piece) and len(machine.words.allowed) <= 21 + len(piece.encode())
    monkeypatch.setattr(bpe, "MAX_STEPS", 50)
    for piece in (" " + "".join(rnd.choice(parts) for _ in range(300)), "a" * 5000):
        assert machine.encode(piece.encode()) == own._encode_single_piece(piece) and machine.n_steps <= 51


def test_utf8_machine():
    rnd = random.Random(8)
    for _ in range(2000):
        data = "".join(rnd.choice("aé日😀") for _ in range(8)).encode()
        if rnd.random() < 0.5:
            data = bytes(rnd.choice(list(data) + [0xE0, 0xF4, 0xC0, 0xED, 0xA0, 0xFF]) for _ in range(12))
        machine, out, at = bpe.Utf8Machine(), [], 0
        while at < len(data):
            n = rnd.randint(1, 4)
            out.append(machine.feed(data[at : at + n]))
            at += n
        assert "".join([*out, machine.feed(b"", final=True)]) == data.decode("utf-8", "replace")


# 10


def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """prints: (doc_id, fingerprint); the least id reachable of each."""
    distinct = list({f for _, f in prints})
    parent = {f: f for f in distinct}

    def root(f):
        while parent[f] != f:
            f = parent[f]
        return f

    for a, b in itertools.combinations(distinct, 2):
        if (a ^ b).bit_count() <= 2:
            parent[root(a)] = root(b)
    least = {}
    for d, f in prints:
        if d is not None:
            least[root(f)] = min(d, least.get(root(f), d))
    return [least.get(root(f)) for _, f in prints]


def test_simhash(docs, rows, none):
    prints = [(r[0], brute_print(r[1])) for r in rows]
    want = Counter((d, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints)))
    assert by_id(simhash.components_of(docs), "fingerprint", "component_id") == want
    assert simhash.components_of(none).count() == 0
    kept = simhash.keep_one(docs.selectExpr("*", "1 as simhash_row", "2 as fingerprint", "3 as component_id"))
    assert kept.columns == [*docs.columns, "simhash_row", "fingerprint", "component_id"]
    assert simhash.keep_one(none).count() == 0 and simhash.keep_one(none).columns == none.columns
    groups = {}
    for (d, f), c in zip(prints, brute_components(prints)):
        groups.setdefault(c if c is not None else ("none", f), []).append(d)
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(min((d for d in g if d is not None), default=None) for g in groups.values())


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 2])
def test_links(spark, bucket):
    """Dense groups around centres, with and without crowded keys."""
    rnd = random.Random(11)
    prints = []
    for i in range(12):
        centre = rnd.getrandbits(64)
        weak = rnd.sample(range(64), 9)
        prints += [centre ^ sum(1 << b for b in rnd.sample(weak, rnd.randint(0, 4))) for _ in range(40)]
    prints += [rnd.getrandbits(64) for _ in range(200)]
    rows = list(enumerate(prints))
    rnd.shuffle(rows)
    df = spark.createDataFrame([(i, f - (1 << 64 if f >> 63 else 0)) for i, f in rows], "doc_id long, fingerprint long")
    distinct = df.select("fingerprint").distinct()
    if bucket != simhash.BUCKET:
        roots = components.components(simhash.links(distinct, bucket))
        least = roots.join(df.withColumnRenamed("fingerprint", "node"), "node").groupBy("root").agg({"doc_id": "min"}).collect()
        want = Counter(brute_components(rows))
        assert {r[1] for r in least} == {c for c, n in want.items() if n > 1 and len({f for (d, f), k in zip(rows, brute_components(rows)) if k == c}) > 1}
    else:
        got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
        assert got == dict(zip((d for d, _ in rows), brute_components(rows)))


@pytest.mark.parametrize("nodes", [components.MAX_NODES, 7])
def test_components_paths(spark, nodes, monkeypatch):
    monkeypatch.setattr(components, "MAX_NODES", nodes)
    rnd = random.Random(12)
    path = list(range(300))
    rnd.shuffle(path)
    links = list(zip(path, path[1:])) + [(1000, i) for i in range(1001, 1400)] + [(2000, 2001), (2001, 2000), (2001, 2001)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(16)).collect()}
    assert got == {**{i: 0 for i in range(300)}, **{i: 1000 for i in range(1000, 1400)}, 2000: 2000, 2001: 2000}
