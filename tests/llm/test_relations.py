"""Spelling variants, URL rules and alignment against brute-force versions, on the driver's small tables and on awkward rows."""

import bisect
import collections
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from seismolake.llm import alignment, spelling, url_rules
from seismolake.llm.common import table
from seismolake.llm.queries import BYTE_LEVEL, PIECES, URL_RULES, op11_spelling, op12_url_rules, op13_alignment, oracle_sql, tokenizer_file

LOWER_ONLY = str.maketrans(spelling.UPPER, spelling.LOWER)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def expected_variants(counts, factor=10):
    """By candidates that share the word, or the word less one character, at a place."""
    shared = collections.defaultdict(set)
    for w in counts:
        shared[w].add(w)
        for k in range(len(w)):
            shared[w[:k] + w[k + 1 :]].add(w)
    near = {w: {x for y in (w, *(w[:k] + w[k + 1 :] for k in range(len(w)))) for x in shared[y] if one_edit(w, x)} for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= factor * counts[w] else None
    rows = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] is not None else None))
    return sorted(rows)


def got_variants(frame):
    return sorted(tuple(r) for r in frame.select("word", "form", "root", "n", "n_near", "form_n").collect())


def document_words(rows):
    counts = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", text or ""):
            run = run.translate(LOWER_ONLY)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def test_spelling_of_documents(spark, sf_dir):
    counts = document_words([(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()])
    got = got_variants(op11_spelling(spark, sf_dir))
    assert got == expected_variants(counts)
    assert any(r[1] for r in got)


@pytest.mark.parametrize("seed", range(3))
def test_spelling_of_dense_words(spark, seed):
    """Words over few letters: many of equal ones in a row, many near each other, chains of forms, ties."""
    rng = random.Random(seed)
    words = {"".join(rng.choice("abÀ"[: 2 + seed % 2]) for _ in range(rng.randint(1, 8))) for _ in range(220)} | {"", "a", "aa", "aaa", "aaaa"}
    counts = {w: 10 ** rng.randint(0, 4) + rng.randint(0, 1) for w in words}
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert got_variants(spelling.variants(frame)) == expected_variants(counts)


def test_spelling_of_awkward_rows(spark):
    long = "x" * 1000
    docs = [(1, None), (2, ""), (None, "Zürich-ESE zürichese"), (3, f"{long} {long}y {long} {long}y"), (3, "wonderful wonderful WONDERFUL wonderfull wonderfull"), (3, "wonderful"), (4, "×÷éàöüßÿ ×÷éàöüßÿ")]
    frame = spark.createDataFrame([(*d, 1, "k", 2) for d in docs], "doc_id long, text string, n int, word string, wid int")
    got = got_variants(spelling.variants(spelling.vocabulary(spelling.damaged_runs(frame))))
    assert got == expected_variants(document_words(docs))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert got_variants(spelling.variants(spelling.vocabulary(spelling.damaged_runs(empty)))) == []
    assert got_variants(spelling.variants(spark.createDataFrame([(None, 5), ("alone", 2)], "word string, n long"))) == [("alone", None, "alone", 2, 0, None)]


def test_spelling_of_very_long_words(spark):
    """A word costs what it has of characters: no square of its length."""
    rng = random.Random(1)
    word = "".join(rng.choice("abcde") for _ in range(200_000))
    frame = spark.createDataFrame([(word, 30), (word + "z", 3), (word[:100_000] + word[100_001:], 2), (word[:7] + "z" + word[8:], 2), (word[::-1], 2)], "word string, n long")
    got = {r[3]: r[1:3] for r in spelling.variants(frame).select("n", F.length("form"), F.sha2("root", 256) == F.sha2(F.lit(word), 256), "n_near").where("n_near > 0").distinct().collect()}
    assert got == {3: (None, True), 1: (200_000, True)}


def test_light_edges_are_few(spark):
    """At most log2 of the words on any word's way, however long the word."""
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(1000)})
    frame = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "wid long, word string")
    most = spelling.light_edges(frame).groupBy("wid").count().agg(F.max("count")).first()[0]
    assert most <= len(words).bit_length()


def expected_verdicts(urls, rules, otherwise="allow"):
    out = []
    for url in urls:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = raw.translate(LOWER_ONLY), re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        out.append((host, path, *(max(fits)[2:] if fits else (None, otherwise))))
    return sorted(out, key=str)


def test_url_rules_of_pages(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet'")
    assert sorted(map(str, con.execute(oracle_sql()["op12_url_rules"]).fetchall())) == sorted(str(tuple(r)) for r in op12_url_rules(spark, sf_dir).collect())


AWKWARD_URLS = [
    None, "", "no scheme org/", "http://", "http://ORG", "http://org/", "https://a.Example.ORG/es/x?/en/1", "ftp://example.org/en/12#a://b", "x://notexample.org/es/", "http://example.org./es/",
    "http://a..org/", "http://.org/", "http://org:80/", "http://com/fr/é", "http://e\u00c9.com/de/", "http://com//fr/", "http://com?x/fr/", "http://a.com/de", "://com/de/", "http://com/de/" + "x" * 100_000, "http://" + "a." * 3000 + "com/fr/",
]


def test_url_rules_of_awkward_rows(spark):
    urls = AWKWARD_URLS + ["http://hot.example.org/en/1"] * 300
    frame = spark.createDataFrame([(u, k, "h", "p") for k, u in enumerate(urls)], "url string, host int, path string, verdict string")
    rules = spark.createDataFrame(URL_RULES + [("block", None, "/"), (None, "com", "/"), ("block", "", "/")], "verdict string, host string, path string")
    got = url_rules.judge(frame, rules)
    assert sorted(map(tuple, got.select("host", "path", "rule", "verdict").collect()), key=str) == expected_verdicts(urls, URL_RULES)
    assert sorted(r[0] for r in got.select("row.host").collect()) == list(range(len(urls)))
    assert url_rules.judge(frame.limit(0), rules).count() == 0
    none = url_rules.judge(frame, rules.limit(0), "block")
    assert none.where("verdict = 'block' and rule is null").count() == len(urls)


def test_url_rules_over_many_blocks(spark, monkeypatch):
    """Rules nested in hosts and paths, swept in blocks of four rows."""
    monkeypatch.setattr(url_rules, "BLOCK_BITS", 2)
    rng = random.Random(3)
    host = lambda: ".".join(rng.choice("ab") for _ in range(rng.randint(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((host(), rng.choice(["", path()])) for _ in range(60))}.values())
    urls = [f"http://{host()}{rng.choice(['', path()])}" for _ in range(300)]
    got = url_rules.judge(spark.createDataFrame([(u,) for u in urls], "url string"), spark.createDataFrame(rules, "verdict string, host string, path string"))
    assert sorted(map(tuple, got.select("host", "path", "rule", "verdict").collect()), key=str) == expected_verdicts(urls, rules)


@pytest.fixture(scope="module")
def tokens():
    import sentencepiece
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(tokenizer_file(BYTE_LEVEL))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(PIECES))
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def both(text):
        if not text:
            return [], []
        a = [(k, bytes(byte_of[c] for c in first.id_to_token(k))) for k in first.encode(" " + text, add_special_tokens=False).ids]
        b = [(k, bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p := second.id_to_piece(k)) else p.replace("▁", " ").encode()) for k in second.encode(text)]
        whole = (" " + text).encode()
        return (a, b) if b"".join(x[1] for x in a) == whole == b"".join(x[1] for x in b) else ([], [])

    return both


def spans(side):
    out, at = [], 0
    for k, raw in side:
        out.append((k, at, at + len(raw)))
        at += len(raw)
    return out


def expected_alignment(rows, tokens):
    docs, counts = [], collections.Counter()
    for doc_id, text in rows:
        a, b = map(spans, tokens(text))
        links, low = [], 0
        for k, s, e in a:
            while low < len(b) and b[low][2] <= s:
                low += 1
            at = low
            while at < len(b) and b[at][1] < e:
                links.append((k, b[at][0]))
                at += 1
        counts.update(links)
        cuts = sorted({e for *_, e in a} & {e for *_, e in b})
        in_group = [collections.defaultdict(list), collections.defaultdict(list)]
        for of, side in zip(in_group, (a, b), strict=True):
            for k, _, e in side:
                of[bisect.bisect_left(cuts, e)].append(str(k))
        groups = ["|".join(",".join(of[g]) for of in in_group) for g in range(len(cuts))]
        docs.append((doc_id, len(a), len(b), len(cuts), links, groups))
    most = collections.Counter()
    for (_, k), n in counts.items():
        most[k] = max(most[k], n)
    out = []
    for doc_id, n_a, n_b, n_groups, links, groups in docs:
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, n_groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=str)


def check_alignment(got, expected):
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected


def test_alignment_of_documents(spark, sf_dir, tokens):
    rows = [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").select("doc_id", "text").collect()]
    check_alignment(op13_alignment(spark, sf_dir), expected_alignment(rows, tokens))


AWKWARD_TEXTS = [
    (1, None), (2, ""), (3, " "), (4, "  two  spaces  "), (5, "<|endoftext|> <s> </s> <unk> <0x41>"), (6, "▁ sign"), (7, "é 　 ß\x1c\x85 'S don't\x01\x00z"), (8, "日本語のテキスト 🙂🙂 ñ"), (None, "none"), (9, "same"), (9, "same"),
    (10, "\n\n\t\n x\r\n"), (11, "a" * 5000), (12, "word and " * 4000), (13, "1234567890" * 50), (14, "\u0301\u200d\ufeffx"),
]


@pytest.mark.parametrize("share", [1, alignment.HOT_SHARE])
def test_alignment_of_awkward_rows(spark, tokens, monkeypatch, share):
    """With all pairs shuffled, and with all broadcast."""
    monkeypatch.setattr(alignment, "HOT_SHARE", share)
    frame = spark.createDataFrame([(*r, 1, "x") for r in AWKWARD_TEXTS], "doc_id long, text string, doc int, links string")
    done = alignment.scored(frame, tokenizer_file(BYTE_LEVEL), tokenizer_file(PIECES))
    check_alignment(done.select("_0", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), expected_alignment(AWKWARD_TEXTS, tokens))
    assert done.where("_2 = 1 and _3 = 'x'").count() == len(AWKWARD_TEXTS)
    # The relational form gives the same, row by row.
    rows = alignment.aligned(frame, tokenizer_file(BYTE_LEVEL), tokenizer_file(PIECES))
    digest = F.when(F.col("n_a") > 0, F.sha2(F.array_join("groups", ";"), 256)).otherwise("").alias("groups_sha256")
    plain = lambda f: sorted(map(str, f.collect()))
    columns = ["kept", "n_a", "n_b", "n_groups", "n_links"]
    assert plain(rows.select(*columns, digest, F.array_sort("pairs").alias("pairs"))) == plain(alignment.summaries(frame, tokenizer_file(BYTE_LEVEL), tokenizer_file(PIECES)).select(*columns, "groups_sha256", "pairs"))
    assert alignment.scored(frame.limit(0), tokenizer_file(BYTE_LEVEL), tokenizer_file(PIECES)).count() == 0
