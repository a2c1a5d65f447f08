"""License scans against plain Python, on random blocks and edge rows."""

import random
import re

from folioscope.llm import licenses

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text):
    return re.findall(PATTERN, (text or "").translate(LOWER))


def brute(text, templates=licenses.TEMPLATES):
    have = words(text)
    places = []
    for phrase, label in licenses.PHRASES.items():
        want = phrase.split()
        places += [(i, label) for i in range(len(have)) if have[i : i + len(want)] == want]
    labels = {label for _, label in places}
    best = 0.0
    for line in (text or "").split("\n"):
        held = set(words(line))
        for label, template in templates:
            wanted = set(template.split())
            share = len(held & wanted) / len(wanted)
            if share >= licenses.THRESHOLD - 1e-9:
                labels.add(label)
                best = max(best, share)
    base = sorted({label for _, label in places})
    starts = [i for i, _ in places]
    return (
        len(have), len(places), min(starts, default=None), max(starts, default=None),
        ",".join(base), ",".join(sorted(labels)), 1.0 if places else best,
    )


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string")
    got = [(r.row.text, *[r[c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")]) for r in licenses.scan(docs).collect()]
    want = [(t, *brute(t)) for _, t, _ in rows]
    key = lambda x: (x[0] is None, x[0] or "")
    got, want = sorted(got, key=key), sorted(want, key=key)
    assert [g[:-1] for g in got] == [w[:-1] for w in want]
    assert all(abs(g[-1] - w[-1]) < 1e-12 for g, w in zip(got, want))


def test_random_blocks(spark):
    random.seed(4)
    rows = []
    for i in range(150):
        lines = []
        for _ in range(random.randint(0, 5)):
            template = random.choice(licenses.TEMPLATES)[1].split()
            drop = random.randint(0, 4)
            for _ in range(drop):
                template.pop(random.randrange(len(template)))
            template.insert(random.randrange(len(template) + 1), "Other")
            if random.random() < 0.3:
                random.shuffle(template)
            lines.append(random.choice([" ", ", ", "-"]).join(template).title())
        rows.append((i, "\n".join(lines), "clash"))
    check(spark, rows)


def test_edge_rows(spark):
    rows = [
        (1, None, None), (2, "", None), (3, " ?!\n-", None), (4, "MIT License mit  license", None),
        (4, "MIT License mit  license", None), (5, "mit\nlicense", None), (6, "permit license", None),
        (7, "Apache License, " * 9000, None), (8, "the MIT-License", None), (9, "mit licenseé", None),
    ]
    check(spark, rows)
    empty = spark.createDataFrame([], "doc_id long, text string, labels string")
    assert licenses.scan(empty).count() == 0


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = licenses.scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
