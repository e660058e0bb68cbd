"""Each operator against a plain version on small tables, with the cases that its docstring defines."""

import collections
import hashlib
import random
import re
import time

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from larkspur.llm import decontaminate, html_text, jaccard, licenses, pieces, q_quotes, q_token_files, quality, quotes, repeats, token_files, url_filter
from larkspur.llm import bytes as bytes_
from larkspur.llm import components as graph
from larkspur.llm.components import components
from tests.compare import same

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DOC = "doc_id long, text string"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def texts(seed, n=60):
    """Documents with copies, near copies, repeated lines, empties, nulls and a very long one."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 7))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    out = [None, "", " \n\t ", "a", "a b c", prose(3000)]
    passage = prose(60)
    while len(out) < n:
        kind = rng.randrange(5)
        if kind == 0:
            out.append(rng.choice(out))
        elif kind == 1 and len(words(out[-1])) > 40:
            w = words(out[-1])
            w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind == 2:
            out.append(f"{prose(30)}\n{passage}\n{prose(20)}")
        elif kind == 3:
            out.append("\n".join([prose(12)] * 3))
        else:
            out.append(prose(rng.randint(1, 150)))
    return list(enumerate(out))


def frame(spark, rows, extra=True):
    d = spark.createDataFrame(rows, DOC)
    return d.selectExpr("*", "'x' AS source", "1 AS n_words", "2 AS kept", "3 AS key", "4 AS n") if extra else d


def test_quality_figures(spark):
    rows = texts(1)
    got = {r.doc_id: r for r in quality.judge(quality.measure(frame(spark, rows))).collect()}
    for i, t in rows:
        w = words(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        covered = {p for k in range(len(w) - 4) if windows[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (t or "").split("\n") if words(x)]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_keeps_rows_whole(spark):
    d = frame(spark, texts(2))
    assert quality.keep(d).columns == d.columns
    assert quality.keep(d.limit(0)).count() == 0


def brute_components(rows, size=4, percent=85):
    lower = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
    sets = {}
    for i, t in rows:
        w = words((t or "").encode().translate(lower).decode())
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("rare", [16, 1])
def test_jaccard(spark, monkeypatch, rare):
    monkeypatch.setattr(jaccard, "RARE", rare)  # 1: every shared token is frequent, every group is large
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    rows = texts(3, 90)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def test_jaccard_empty_null_and_repeated_ids(spark):
    assert jaccard.join(frame(spark, [])).count() == 0
    rows = [(1, "a b c d e"), (1, "a b c d e"), (None, "a b c d e"), (2, "A B C D E")]
    assert sorted((tuple(r) for r in jaccard.join(frame(spark, rows)).collect()), key=str) == [(1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert sorted(r.doc_id or 0 for r in jaccard.keep_first(frame(spark, rows)).collect()) == [0, 1]


def test_pipeline_drops_near_copies_by_its_own_rule(spark):
    w = [f"w{k}" for k in range(200)]
    scattered = [f"x{k}" if k in (30, 70, 110, 150) else x for k, x in enumerate(w)]  # 176 of 216 five-word shingles, 181 of 213 four-word ones
    run = [f"y{k}" if 90 <= k < 104 else x for k, x in enumerate(w)]  # 178 of 214, 180 of 214
    far = [f"z{k}" if k in (20, 60, 100, 140, 180) else x for k, x in enumerate(w)]  # 171 of 221
    rows = [*texts(12, 40), *((500 + 10 * k, " ".join(t)) for k, t in enumerate((w, scattered, run, far)))]
    kept = {i for i, (_, first) in brute_components(rows, 5, 80).items() if i == first}
    assert {500, 530} <= kept and not {510, 520} & kept
    assert {r.doc_id for r in corpus_pipeline.jaccard_join(spark, frame(spark, rows), "").collect()} == kept


def brute_repeats(rows, length=200):
    data = [(t or "").encode() for _, t in rows]
    seen = collections.Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(d) else 0
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        out.append((len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [20_000, 1])
def test_repeats(spark, monkeypatch, group):
    monkeypatch.setattr(repeats, "GROUP", group)  # 1: every mixed group is counted as rows
    rows = [*texts(4), (900, "ab" * 400), (901, "x" + "ab" * 150)]
    got = [tuple(r) for r in repeats.report(frame(spark, rows)).orderBy("doc_id").collect()]
    assert got == [(i, *x) for (i, _), x in zip(rows, brute_repeats(rows), strict=True)]


def test_repeats_with_repeated_and_null_ids(spark):
    t = "lorem ipsum " * 5 + "é" * 120
    rows = [(1, t), (1, t), (None, t), (2, "short"), (3, None)]
    got = sorted((r.doc_id or 0, r.n_removed) for r in repeats.report(frame(spark, rows)).collect())
    assert got == [(0, 300), (1, 300), (1, 300), (2, 0), (3, 0)]
    cut = {r.doc_id: r.text for r in repeats.remove(frame(spark, rows[3:])).collect()}
    assert cut == {2: "short", 3: None}
    assert repeats.report(frame(spark, [])).count() == 0


def test_refined_equals_counting():
    rng = np.random.default_rng(5)
    for _ in range(30):
        data = rng.integers(97, 99, 500).astype(np.uint8)
        data[250:470] = data[10:230]
        starts = np.arange(len(data) - repeats.LENGTH + 1)
        seen = collections.Counter(data[i : i + repeats.LENGTH].tobytes() for i in starts)
        assert repeats.refined(data, starts).tolist() == [seen[data[i : i + repeats.LENGTH].tobytes()] > 1 for i in starts]


def test_templates(spark):
    item = "If Tom has 12 apples and buys 7 more apples how many apples does Tom have in total now at 3 kg each"
    docs = [
        (1, "Well. If Ann has 31 apples and buys 9 more apples how many apples does Ann have in total now at 5 kg each"),
        (2, "If Ann has 31 apples and buys 9 more apples how many apples does Bob have in total now at 5 kg each"),
        (3, item), (4, None), (5, ""), (None, "nothing of the kind is in here at all, is it"),
    ]
    bench = spark.createDataFrame([(7, item), (8, None), (9, "too short")], "item_id long, text string")
    got = {r.doc_id: (r.leaked, r.items) for r in decontaminate.report(frame(spark, docs), bench).collect()}
    assert got == {1: (True, "7"), 2: (False, ""), 3: (True, "7"), 4: (False, ""), 5: (False, ""), None: (False, "")}
    assert {r.doc_id for r in decontaminate.remove(frame(spark, docs), bench).collect()} == {2, 4, 5, None}


@pytest.mark.parametrize("bound", [200_000, 0])
def test_short_and_number_heavy_items(spark, monkeypatch, bound):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
    france, numbers = "What is the capital of France?", "Add 12, 7, 3, 4, 2, 15, 9 and 8"
    mixed = "Take 1 and 2 from 3 or 4 but 5 to 6 by 7 at 8 up 9"  # every window has four slots, nine plain words in all
    items = [(1, france), (2, numbers), (3, mixed), (4, "Two words"), (5, ""), (6, "9"), (7, "...")]
    docs = [
        (1, f"A quiz. {france} Say it."), (2, "so the quiz What is the Capital of Spain, then"), (3, "What is the capital of"),
        (4, f"Sum: {numbers}."), (5, "Add 12, 7, 3, 4, 2, 15, 8 and 8"), (6, "and " + mixed.replace("9", "77").lower()), (7, mixed.replace("9", "8")),
        (8, "just two words in it"), (9, "word two"), (10, None), (11, ""), (12, "what is the capital of France"), (13, "so the quiz What is the capital of Spain then"), (None, f"{numbers} or {france}"),
    ]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r.items for r in decontaminate.report(frame(spark, docs), bench.where("item_id != 6")).collect()}
    assert got == {1: "1", 2: "", 3: "", 4: "2", 5: "", 6: "3", 7: "", 8: "4", 9: "", 10: "", 11: "", 12: "1", 13: "1", None: "1,2"}
    one = {r.doc_id for r in decontaminate.report(frame(spark, docs), bench.where("item_id = 6")).where("leaked").collect()}
    assert one == {4, None}


def test_templates_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    test_templates(spark)


def test_licenses_against_all_windows():
    one = licenses.scanner()
    rng = random.Random(6)
    for notice, label, edits in one.notices:
        for _ in range(20):
            text = list(notice)
            for _ in range(rng.randint(0, edits)):
                text[rng.randrange(len(text))] = rng.choice("qxz")
            found = one.fuzzy("some words before " + "".join(text) + " and after")
            assert any(s["label"] == label for s in found), (notice, "".join(text))
    assert one.fuzzy("nothing of that kind stands here") == []


def test_near_and_adjacent_notices():
    one = licenses.scanner()
    spans = lambda t: [(s["label"], s["first_word"], s["last_word"], s["edits"]) for s in one.fuzzy(t)]
    nc, sa, mit, mat = "licensed under cc by nc 4 0", "licensed under cc by sa 4 0", "licensed under the mit license", "licensed under the mat license"
    assert one.scan("Licensed under CC BY-NC 4.0.")["labels"] == "cc-by,cc-by-nc" and one.scan("Licensed under CC BY-SA 4.0.")["labels"] == "cc-by,cc-by-sa"
    assert one.scan("Licensed under CC BY-ND 4.0.")["labels"] == "cc-by"
    assert spans(f"{nc} {sa}") == [("cc-by-nc", 0, 6, 0), ("cc-by-sa", 7, 13, 0)] and spans(nc.replace("nc", "nx")) == [("cc-by-nc", 0, 6, 1)]
    for other in ("isc", "mpl", "bsd", "foo"):
        assert spans(mit.replace("mit", other)) == [], other
    assert spans(f"{mat} {mit}") == [("mit", 0, 4, 1), ("mit", 5, 9, 0)]
    assert spans(" ".join([mit, mat, mit, mat, mat])) == [("mit", 5 * k, 5 * k + 4, k % 2 or k // 4) for k in range(5)]


def test_license_rows(spark):
    rows = [(1, "Released under the MIT License."), (2, "x GNU General Public License y mit license"), (3, None), (4, "Releesed undr the MlT License")]
    got = {r.doc_id: r for r in licenses.scan(frame(spark, rows)).collect()}
    assert (got[1].n_base, got[1].first_word, got[1].base_labels, got[1].score) == (1, 3, "mit", 1.0)
    assert (got[2].n_base, got[2].first_word, got[2].last_word, got[2].base_labels) == (2, 1, 6, "gpl,mit")
    assert (got[3].n_words, got[3].n_base, got[3].labels) == (0, 0, "")
    assert got[4].base_labels == "" and got[4].labels == "mit" and 0 < got[4].score < 1


def test_pieces_equal_library():
    import sentencepiece

    one, lib = pieces.encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = random.Random(7)
    letters = " " * 6 + "abcdetheingion \n\téß日本#a.,01 "
    for _ in range(300):
        t = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        ids = one.encode([t])[0].tolist()
        assert ids == lib.encode(t) and pieces.decode(one.m, ids) == t


def test_stream_holds_a_bounded_window():
    m = pieces.encoder(MODEL).m
    stream, most, ids = pieces.Stream(m), 0, []
    text = "thenationalisationingofthe" * 2000
    for k in range(0, len(text), 50):
        ids += stream.feed(text[k : k + 50])
        most = max(most, len(stream.buffer))
    ids += stream.end()
    assert most < 200 and "".join(m.text[i] for i in ids) == text


def test_piece_rows(spark):
    rows = texts(8)
    got = {r.doc_id: r for r in pieces.encode(frame(spark, rows), MODEL).collect()}
    assert all(r.round_trip for r in got.values()) and got[0].n_ids == 0


def test_separator_scan(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "GROUP", 3)
    rng, rows, expected = random.Random(9), [], []
    for k in range(6):
        sizes = [rng.choice([0, 0, 1, 3, 30, 200]) for _ in range(rng.randint(0, 40))]
        ids = [x for n in sizes for x in [*[1] * n, 9]] + [1] * (5 * (k % 2))
        path = str(tmp_path / f"{k}.bin")
        np.array(ids, "<u2").tofile(path)
        rows.append((path, 2 * len(ids)))
        expected += [(path, i, n) for i, n in enumerate([*sizes, *[5] * (k % 2)])]
    files = spark.createDataFrame(rows, "path string, size long")
    blocks = token_files.blocks_of(spark, files, 2, block=7)
    found = token_files.scanned(blocks, "uint16", 9)
    assert sorted(tuple(r) for r in token_files.counts(blocks, found).collect()) == sorted(expected)


def test_token_counts_of_documents(spark, tmp_path):
    rows = [*texts(14, 30), (800, "It's 1,000 km; über 日本\n\n  end")]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    one = q_token_files.encoding()
    got = sorted(tuple(r) for r in q_token_files.op5_token_counts(spark, str(tmp_path)).collect())
    assert got == [(i, len(one.encode_ordinary(t or ""))) for i, t in rows]


def test_minimum_cut_is_minimal():
    import itertools

    rng = random.Random(10)
    for _ in range(200):
        n = rng.randint(1, 7)
        c = [rng.choice([-3, -2, -1, -0.5, 0.5, 1, 2, 3]) for _ in range(n)]
        e = {(i, j): rng.choice([0.5, 1, 2]) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}
        cost = lambda x: sum(max(c[i], 0) * (not x[i]) + max(-c[i], 0) * x[i] for i in range(n)) + sum(w * (x[i] != x[j]) for (i, j), w in e.items())  # noqa: B023, E731
        assert abs(cost(html_text.minimum_cut(c, e)) - min(map(cost, itertools.product([False, True], repeat=n)))) < 1e-9


def test_html(spark):
    page = (
        "<html><head><title>T</title><script>if (a < b) {}</script></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class=ad>Buy now</div>"
        "<article><h1>Head &amp; line</h1><p>One  two<br>three<p>Short</p></article><div id='comments'><p>I like it very much</p></div><form>Name <input></form><footer>&copy; us</footer>"
    )
    rows = spark.createDataFrame([(1, "u", page), (2, "u", None), (3, None, ""), (4, "u", "<p>unclosed <b"), (5, "u", "plain < text")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.extract(rows).collect()}
    assert got == {1: "Head & line\nOne two three\nShort", 2: "", 3: "", 4: "unclosed", 5: "plain < text"}


def test_quotes(spark):
    rows = [
        (1, 0, "a", "Hello there\nHow are you?"), (1, 1, "b", "> hello   there\n> how are you?\nFine.\nAnd you?"), (1, 2, "a", "Unrelated"),
        (1, 3, "c", "B wrote:\n> > Hello there\n> > how are you?\n> Fine.\n> And you?\nGood"), (1, 4, "c", ">nothing known\nhm"), (2, 0, None, None), (2, None, "x", "y"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS mark")
    got = {(r.conv_id, r.turn): (r.text, r.n_linked, r.parent_turn, r.thread_turn) for r in quotes.linked_messages(d).collect()}
    assert got[1, 1] == ("Fine.\nAnd you?", 1, 0, 0) and got[1, 3] == ("Good", 2, 1, 0) and got[1, 4] == ("hm", 0, None, 4) and got[2, 0] == ("", 0, None, 0)
    talks = quotes.conversations(d)
    assert [r.turns for r in talks.where("conv_id = 1").collect()] == ["0,1,3,2,4"]
    con = duckdb.connect()
    conversations = d.drop("mark").toArrow()  # noqa: F841  the SQL reads it by name
    same(talks, con.execute(q_quotes.SQL))


def test_partial_quotes(spark):
    three, paragraphs = "One is here.\nTwo comes next.\nThree ends it.", "First part\ngoes on\n\nSecond part\n\nThird part\nends"
    rows = [
        (1, 0, "a", three), (1, 1, "a", paragraphs), (1, 2, "b", "> two  comes next.\n> Three ends it.\nYes"), (1, 3, "b", "> Second part\n>\n> Third part\n> ends\nNo"),
        (1, 4, "c", "> One is here.\n> Three ends it.\nnot in a row"), (1, 5, "c", "> One is here.\n> Two comes next.\n>\n> Second part\n> Third part\nfrom both"),
        (1, 6, "d", ">\n> First part goes on\n>\n> unknown\nrewrapped"), (1, 7, "d", "> > Two comes next.\n> > Three ends it.\n> Yes\nnested"),
        (1, 8, "e", "> later line\n> and more\nearly"), (1, 9, "e", "later line\nand more\nand most"), (1, 10, "f", "x\nx\nx\ny"), (1, 11, "f", "> x\n> x\n> y\nrepeats"),
        (2, 3, "g", "> Two comes next.\n> Three ends it.\nother talk"),
    ]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.turn): (r.n_quotes, r.n_linked, r.parent_turn, r.thread_turn) for r in quotes.linked_messages(d).collect()}
    assert got == {
        (1, 0): (0, 0, None, 0), (1, 1): (0, 0, None, 1), (1, 2): (1, 1, 0, 0), (1, 3): (1, 1, 1, 1), (1, 4): (1, 0, None, 4), (1, 5): (1, 1, 1, 1), (1, 6): (1, 1, 1, 1),
        (1, 7): (2, 2, 2, 0), (1, 8): (1, 0, None, 8), (1, 9): (0, 0, None, 9), (1, 10): (0, 0, None, 10), (1, 11): (1, 1, 10, 10), (2, 3): (1, 0, None, 3),
    }


def test_urls(spark):
    rows = [(1, "http://WWW.Spam.com/a/"), (2, "https://x.spam.com/?q"), (3, "no url"), (4, None), (5, "http://ok.org/en/1"), (6, "http://one.net/p/"), (6, "http://one.net/p/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 AS entry", "2 AS block")
    listed = spark.createDataFrame([("spam.com/",), ("one.net/p",)], "entry string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(pages, [("block", "org", "/en/"), ("allow", "ok.org", "/en/1")], listed).collect())
    assert got == [(1, "www.spam.com", "/a/", None, "block"), (2, "x.spam.com", "/", None, "block"), (3, "", "", None, "allow"), (4, "", "", None, "allow"),
                   (5, "ok.org", "/en/1", "ok.org/en/1", "allow"), (6, "one.net", "/p/", None, "block"), (6, "one.net", "/p/", None, "block")]


@pytest.mark.parametrize("forest", [1_000_000, 0])
def test_components(spark, monkeypatch, forest):
    monkeypatch.setattr(graph, "FOREST", forest)  # 0: stars in rounds
    rng = random.Random(11)
    pairs = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)]
    root = {x: x for p in pairs for x in p if p[0] != p[1]}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    got = {tuple(r) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in root}


def test_decontamination_is_linear_in_the_text(spark, monkeypatch):
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(500)]
    item = "a pump fills a tank of 40 litres in 7 minutes while Anna drinks tea with Boris"
    bench = spark.createDataFrame([(1, item), (2, "why is it so")], "item_id long, text string")

    def took(n):
        words_ = [rng.choice(vocab) if k % 5 else str(k) for k in range(n)]
        doc = spark.createDataFrame([(1, " ".join(words_) + " " + item + " " + " ".join(words_) + " why is it so " + "why is it so " * 50)], "doc_id long, text string")
        began = time.perf_counter()
        assert decontaminate.report(doc, bench).first().items == "1,2"
        return time.perf_counter() - began

    for bound in (200_000, 0):
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", bound)
        took(1000)
        assert took(40_000) < 3 * took(20_000) + 2


def test_decontamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOC), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a text of ten words or so that says nothing much")], DOC)
    assert decontaminate.report(docs, bench).collect() == []
    assert [tuple(r) for r in decontaminate.report(some, bench).collect()] == [(1, False, 0, "")]
    assert decontaminate.remove(docs, spark.createDataFrame([(1, "what is it")], "item_id long, text string")).collect() == []


def test_windows_are_sorted_as_suffixes():
    rng = np.random.default_rng(6)
    for alphabet in ([0, 1], [97, 98], [0], range(256)):
        data = rng.choice(np.array(list(alphabet), np.uint8), 700)
        data[400:640] = data[30:270]
        starts = np.arange(len(data) - repeats.LENGTH + 1)
        at = repeats.sorted_windows(data, starts, np.minimum(len(data) - np.arange(len(data)), repeats.LENGTH))
        cut = [data[i : i + repeats.LENGTH].tobytes() for i in at]
        assert sorted(at) == starts.tolist() and cut == sorted(cut)


def test_suffixes_of_kinds_are_sorted_about_once(monkeypatch):
    rng, pieces, work, plain = np.random.default_rng(7), [], [], repeats._refine
    for gram in range(8):
        base = rng.integers(97, 123, 300).astype(np.uint8)
        for k in range(1 if gram < 4 else 6):  # four q-grams of one kind with copies, four of kinds that nearly agree
            near = base.copy()
            near[rng.integers(0, 300, k)] = 48 + k
            pieces.append((gram, gram, k, 3 if k == 0 else 1, k, 0, near[k:].tobytes()))
    monkeypatch.setattr(repeats, "_refine", lambda at, *rest: work.append(len(at)) or plain(at, *rest))
    got = collections.Counter()
    for r in repeats._spans(pieces).to_pylist():
        got.update((r["gram"], r["b"], i) for i in range(r["start"], r["stop"] - repeats.LENGTH + 1))
    seen = collections.Counter()
    windows = [(p, i, (p[0], p[-1][i : i + repeats.LENGTH])) for p in pieces for i in range(len(p[-1]) - repeats.LENGTH + 1)]
    for p, _, window in windows:
        seen[window] += p[3]
    assert got == collections.Counter((p[0], p[2], i) for p, i, window in windows if seen[window] > 1)
    assert sum(work) <= sum(len(p[-1]) for p in pieces)


def test_words_of_equal_polynomial_hash_are_told_apart():
    word = [0]
    while len(word) < 1024:
        word += [1 - x for x in word]
    a, b = bytes(97 + x for x in word), bytes(98 - x for x in word)
    one, two = (repeats.records(np.frombuffer(x, np.uint8)) for x in (a, b))
    assert not set(zip(one[1].tolist(), one[2].tolist(), strict=True)) & set(zip(two[1].tolist(), two[2].tolist(), strict=True)) or a[:300] in b or b[:300] in a
    both = np.frombuffer(a + b, np.uint8)
    starts = np.array([0, 1024 - repeats.LENGTH, 1024])
    want = [a[: repeats.LENGTH], a[-repeats.LENGTH :], b[: repeats.LENGTH]]
    assert repeats.refined(both, starts).tolist() == [want.count(x) > 1 for x in want]


def test_long_words_of_equal_polynomial_hash_are_two_shingles():
    word = [0]
    while len(word) < 2048:
        word += [1 - x for x in word]
    a, b = ("".join(chr(97 + (x ^ flip)) for x in word) for flip in (0, 1))
    assert len({int(bytes_.shingles(w, 4)[0][0]) for w in (a, b)}) == 2


def test_a_very_frequent_token(spark):
    rng = random.Random(8)
    common = "this line stands in every text of the source"
    rows = [(k, f"{common} " + " ".join(rng.choice("abcdefgh") * rng.randint(1, 6) for _ in range(rng.randint(6, 30)))) for k in range(80)]
    rows += [(100 + k, rows[k][1]) for k in range(10)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join(frame(spark, rows)).collect()}
    assert got == brute_components(rows)


def edited(rng, text, edits):
    out = list(text)
    for _ in range(edits):
        kind, at = rng.randrange(3), rng.randrange(len(out))
        out[at : at + (kind > 0)] = [] if kind == 2 else [rng.choice("qxz ")]
    return " ".join("".join(out).split())


def test_seeds_lose_no_match_of_any_window():
    one, rng, met = licenses.scanner(), random.Random(7), 0
    for _ in range(300):
        notice, _, k = rng.choice(one.notices)
        text = f"some words {edited(rng, notice, rng.randint(0, k + 2))} and {edited(rng, rng.choice(one.notices)[0], rng.randint(0, 3))} end"
        windows = one.windows(text)
        for which, pattern in enumerate(one.patterns):
            everywhere = pattern.search(text) is not None  # every window, without seeds
            assert everywhere == any(pattern.search(text, a, b) for a, b in windows.get(which, []))
            met += everywhere
    assert met > 300


def test_licenses_that_are_none():
    scan = lambda t: licenses.scanner().scan(t)["labels"]
    for text in ("Released under the BSD License", "Released under the GPL license", "Licensed under the ISC license", "Mozilla Public License version 1 1", "the public was granted a license"):
        assert scan(text) == "", text
    assert scan("Mozilla Publik License, version 2.0") == "mpl"


def test_licenses_of_odd_tables(spark):
    assert licenses.scan(frame(spark, [])).collect() == []
    long = "mit license " * 4_000
    began = time.perf_counter()
    got = licenses.scan(frame(spark, [(1, long), (1, "x"), (1, "x")])).collect()
    assert sorted(r.n_base for r in got) == [0, 0, 4_000] and time.perf_counter() - began < 30
    assert max(r.last_word for r in got if r.n_base) == 7_998
