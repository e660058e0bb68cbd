"""The classifier's fit, what the cut adds to it on pages of known articles, and odd pages."""

import random
import time

from larkspur.llm import html_text, html_training


def test_weights_are_those_of_the_fit():
    assert html_training.fit(html_training.pages(*html_training.TRAINING)) == html_text.WEIGHTS


def test_cut_beats_the_sign_on_held_out_pages():
    cut, sign, differ = html_training.accuracy(html_training.pages(3, 400))
    assert cut > 0.96 and cut > sign + 0.01 and differ > 0.03


def test_flow_is_needed_and_minimal():
    rng = random.Random(4)
    for _ in range(60):
        n = rng.randint(2, 9)
        costs = [rng.uniform(-2, 2) for _ in range(n)]
        edges = {(i, i + 1): rng.uniform(0, 3) for i in range(n - 1)} | {(i, i + 2): rng.uniform(0, 1) for i in range(n - 2)}

        def energy(labels, costs=costs, edges=edges):
            return sum(abs(c) for c, x in zip(costs, labels, strict=True) if x != (c >= 0)) + sum(w for (i, j), w in edges.items() if labels[i] != labels[j])

        best = min(energy([bool(k >> i & 1) for i in range(n)]) for k in range(2**n))
        assert abs(energy(html_text.minimum_cut(costs, edges)) - best) < 1e-9


def test_neighbours_decide_uncertain_blocks():
    prose = " ".join(["word"] * 40)
    page = f"<div><p>{prose}.</p><p>short</p><p>{prose}.</p></div><div><ul><li><a href=x>one</a></li><li>see our other offers now</li><li><a href=x>two</a></li><li><a href=x>six</a></li></ul></div>"
    assert html_text.main_text(page).split("\n") == [f"{prose}.", "short", f"{prose}."]


def test_odd_pages(spark):
    rows = [(1, "u", "<div>" * 3000 + "deep"), (2, "u", "</p></div>stray <b>end"), (2, "u", "</p></div>stray <b>end"), (3, None, None), (None, "u", "<!-- open"), (4, "u", "<p hidden>gone</p>")]
    pages = spark.createDataFrame([(*r, 7, "x") for r in rows], "page_id long, url string, html string, n_chars int, text string")
    got = html_text.extract(pages).collect()
    assert sorted((r.page_id is None, r.page_id, r.text) for r in got if r.page_id == 2) == [(False, 2, "stray end")] * 2
    assert len(got) == len(rows) and {r.text for r in got if r.page_id in (None, 3, 4)} == {""}
    assert html_text.extract(pages.limit(0)).collect() == []


def test_time_is_linear_in_the_page():
    def took(n):
        page = "<div><p>alpha</p><span>beta gamma</span></i></div>" * n
        began = time.perf_counter()
        html_text.main_text(page)
        return time.perf_counter() - began

    took(500)
    assert took(16000) < 4 * took(8000) + 0.2
