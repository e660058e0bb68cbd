"""Licenses: notices that are others', denied or marked; base figures against SQL; columns of other names in stages."""

import random

import pytest

from larkspur.llm import decontaminate, licenses, repeats


@pytest.mark.parametrize("text", [
    "Released under the Vim License", "released under the SIL license", "Released under the NIST license", "licensed under the gift license", "licensed under the summit license",
    "Permission is hereby denied, free of charge, to any person obtaining a copy of this software",
    "Permission is hereby not granted free of charge to any person obtaining a copy of this software",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this font software",
    "Redistribution and use in source and binary forms, with or without modification are not permitted",
    "This is not licensed under the Apache License, version 2.0", "It isn't released under the MIT license", "no longer licensed under the MIT license",
])
def test_none_but_exact_phrases(text):
    got = licenses.scanner().scan(text)
    assert got["labels"] == got["base_labels"] and got["spans"] == []


@pytest.mark.parametrize(("text", "labels"), [
    ("CC BY-SA 3.0", "cc-by,cc-by-sa"), ("under CC BY-NC-SA 4.0 now", "cc-by,cc-by-nc-sa"), ("cc by nc nd", "cc-by,cc-by-nc-nd"), ("cc by nd", "cc-by"), ("CC BY 4.0", "cc-by"), ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ("licensed under a Creative Commons Attribution NonCommercial license", "cc-by-nc"), ("licensed under a Creative Commons Attribution-Share Alike 3.0 license", "cc-by-sa"),
    ("licensed under a Creative Comons Attribution-NonCommercial-ShareAlike 4.0", "cc-by-nc-sa"), ("licensed under a creative commons attribution", "cc-by"),
    ("There is no warranty. Licensed under the Apache Licence, Version 2.0", "apache"), ("Permission is herby granted free of charge, to any person obtaining a copy of this sofware", "mit"),
    ("Redistribution and use in source and binary forms, with or without modifcation, are permitted", "bsd"), ("released under the mit licence", "mit"), ("released under mit license", "mit"),
])
def test_labels(text, labels):
    assert licenses.scanner().scan(text)["labels"] == labels


def test_versions_and_places():
    spans = lambda t: [(s["label"], s["first_word"], s["last_word"], s["version"]) for s in licenses.scanner().scan(t)["spans"]]
    assert spans("see CC BY-NC-SA 4.0 here") == [("cc-by-nc-sa", 1, 4, "4.0")]
    assert spans("Licensed under the Apache License, Version 2.0") == [("apache", 0, 7, "2.0")]
    assert spans("licensed under the GNU General Public License version 3") == [("gpl", 0, 7, "3")]
    assert spans("licensed under a creative commons attribution non commercial 2 5") == [("cc-by-nc", 0, 7, "2.5")]


def plain_labels(text):
    """Every notice against the whole text, without seeds or windows, by the same rule of misspellings."""
    joined = b" ".join(licenses.words_of(text)).decode("utf-8", "replace")
    one = licenses.scanner()
    return {label for (n, label, _), pattern in zip(one.notices, one.patterns) if (m := pattern.search(joined)) and one.own(n, joined[joined.rfind(" ", 0, m.start() + 1) + 1 : e if (e := joined.find(" ", m.end())) >= 0 else len(joined)], joined[: joined.rfind(" ", 0, m.start() + 1) + 1])}


def test_misspelt_notices_are_found():
    rng, one, lost, n = random.Random(11), licenses.scanner(), 0, 0
    for notice, label in licenses.NOTICES:
        for _ in range(12):
            words = notice.split()
            for at in rng.sample(range(len(words)), max(1, len(notice) // 30)):
                w = words[at]
                if len(w) > 3 and not w.isdigit():
                    k = rng.randrange(1, len(w) - 1)
                    words[at] = rng.choice([w[:k] + w[k + 1 :], w[:k] + w[k] + w[k:], w[:k] + rng.choice("aeiou") + w[k + 1 :], w[:k] + w[k + 1] + w[k] + w[k + 2 :]])
            text = f"some text {' '.join(words)} and more"
            got = set(filter(None, one.scan(text)["labels"].split(",")))
            assert plain_labels(text) <= got or label in got
            n, lost = n + 1, lost + (label not in got)
    assert lost <= n // 50


def test_base_figures_equal_sql(spark, sf, duck):
    words = r"[x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+') IF x <> '']"
    hits = " ".join(f"UNION ALL SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM d, range(1, len(w) + 1) r(i) WHERE w[i:i + {p.count(' ')}] = [{', '.join(repr(x) for x in p.split())}]" for p, label in licenses.PHRASES)
    sql = f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), h AS (SELECT NULL::BIGINT AS doc_id, NULL::BIGINT AS pos, NULL AS label WHERE false {hits})
      SELECT d.doc_id, len(any_value(w)), count(h.pos), min(pos), max(pos), coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') FROM d LEFT JOIN h USING (doc_id) GROUP BY d.doc_id"""
    got = licenses.scan(spark.read.parquet(f"{sf}/documents.parquet")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect()
    assert sorted(map(tuple, got)) == sorted(duck.execute(sql).fetchall())


def test_columns_of_any_name_stay(spark):
    text = "a passage that is repeated in both texts " * 12
    names = ["doc_id", "text", "found_id", "_spans", "spans", "_key", "row", "item_id", "h"]
    docs = spark.createDataFrame([(1, text + "one", *"abcdefg"), (2, "two " + text, *"abcdefg"), (3, None, *"abcdefg"), (3, "short", *"abcdefg")], ["doc_id", "text", *names[2:]])
    out = repeats.remove(docs)
    assert out.columns == names and {tuple(r)[2:] for r in out.collect()} == {tuple("abcdefg")} and out.count() == 4
    bench = spark.createDataFrame([(5, "the quick brown fox jumps over the lazy dog near a quiet river bank today")], "item_id long, text string")
    leaky = spark.createDataFrame([(1, "see the quick brown fox jumps over the lazy dog near a quiet river bank today", *"abcdefg"), (2, "clean", *"abcdefg")], ["doc_id", "text", *names[2:]])
    left = decontaminate.remove(leaky, bench)
    assert left.columns == names and [r.doc_id for r in left.collect()] == [2]
    assert [r.leaked for r in decontaminate.report(leaky, bench).orderBy("doc_id").collect()] == [True, False]
    scanned = licenses.scan(docs)
    assert scanned.count() == 4 and "spans" in scanned.columns
