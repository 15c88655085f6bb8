"""License scans against a plain version over the same sentences and rules."""

import random
import re
import textwrap

from pyspark.sql import functions as F

from citetrace.llm import licences

SCHEMA = "doc_id long, text string"


def plain_scan(text):
    """Identifiers and licences, by trying every known sentence at every piece."""
    known = {tuple(licences.plain(t).split()): i for i, t in licences.ALL_SENTENCES}
    pieces = []
    for line in re.split(r"\n", text or ""):
        pieces += re.split(r"(?<=[.!?;:])[ \t\x0b\f\r]+", line)
    pieces = [w for w in (re.findall("[a-z0-9]+", re.sub("[A-Z]", lambda m: m[0].lower(), p)) for p in pieces) if w]
    ids = []
    for i in range(len(pieces)):
        joined, found = [], None
        for p in pieces[i : i + 120]:
            joined += p
            found = known.get(tuple(joined), found)
        if found:
            ids.append(found)
    stretches, names = [[]], set()
    for x in ids:
        if x in licences.HEADS:
            stretches.append([])
        stretches[-1].append(x)
    for s in stretches:
        hold = [(name, rule) for name, rule in licences.ALL_RULES if (lambda rest, rule=rule: all(x in rest for x in rule))(iter(s))]
        names |= {name for name, rule in hold if not any(other != name and len(longer) > len(rule) and (lambda rest, rule=rule: all(x in rest for x in rule))(iter(longer)) for other, longer in hold)}
    return ids, sorted(names)


def documents():
    rng = random.Random(21)
    text = dict(licences.ALL_SENTENCES)
    rows = [None, "", "no licence at all; nothing", "licen " * 40_000 + text["mit-grant"]]
    for name, rule in licences.ALL_RULES:
        width = rng.choice([60, 66, 72, 80, 10_000])
        body = [text[i] + rng.choice([".", ";", ":", ". "]) for i in rule]
        way = rng.choice([str, str.upper, str])
        mark = rng.choice(["", "# ", " * ", "// "])
        rows.append("A file\n\n" + "\n\n".join(textwrap.fill(way(x), width, initial_indent=mark, subsequent_indent=mark, break_long_words=False, break_on_hyphens=False) for x in body) + "\n\nthe end")
    for _ in range(60):
        parts = [rng.choice([text[i], "some other sentence", "permission", "é ü licence"]) for i in rng.choices(sorted(text), k=rng.randrange(1, 9))]
        rows.append(rng.choice([". ", ".\n", "\n", ";  "]).join(parts))
    bsd = [text[i] for i in ("bsd-redistribution", "bsd-source", "bsd-binary", "bsd-endorse")]
    rows += ["\n\n".join(bsd), "\n\n".join(bsd + bsd[:3]), "\n\n".join(bsd[:3])]
    return list(enumerate(rows))


def test_against_the_plain_version(spark):
    rows = documents()
    got = {r.doc_id: r for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i, t in rows:
        assert (got[i].sentence_ids, got[i].licences) == plain_scan(t), (i, t[:200] if t else t)
    found = {x for r in got.values() for x in r.licences}
    assert found == {name for name, _ in licences.ALL_RULES}
    n = len(rows)
    assert [got[i].licences for i in (n - 3, n - 2, n - 1)] == [["BSD-3-Clause"], ["BSD-2-Clause", "BSD-3-Clause"], ["BSD-2-Clause"]]


def test_every_sentence_is_in_a_rule_and_marked():
    used = {i for _, rule in licences.ALL_RULES for i in rule}
    assert used == {i for i, _ in licences.ALL_SENTENCES}
    marks = re.compile("|".join(m.replace(" ", "[^a-z0-9]+") for m in licences.MARKS))
    assert all(marks.search(t.lower()) for _, t in licences.ALL_SENTENCES)
    plain = [licences.plain(t) for _, t in licences.ALL_SENTENCES]
    assert len(set(plain)) == len(plain)


def test_odd_rows(spark):
    rows = [(1, "MIT License"), (1, "MIT License"), (None, "MIT License"), (2, None)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("licences", F.lit("x")).withColumn("_s", F.lit(1)).withColumn("sentence_ids", F.lit(1))
    got = sorted(((r.doc_id, r.licences) for r in licences.scan(df).collect()), key=str)
    assert got == [(1, ["MIT"]), (1, ["MIT"]), (2, []), (None, ["MIT"])]
    assert licences.scan(df.limit(0)).count() == 0
