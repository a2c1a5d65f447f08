"""Window hits and longest matches against brute force."""

import random
import re

from folioscope.llm import decontaminate

LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        have, hit, found = words(text), set(), set()
        for item_id, item in items:
            want = words(item)
            size = min(window, len(want))
            for i in range(len(want) - size + 1) if want else ():
                for j in range(len(have) - size + 1):
                    if have[j : j + size] == want[i : i + size]:
                        hit.update(range(j, j + size))
                        if item_id is not None:
                            found.add(item_id)
        out.append((doc_id, len(have), len(hit), sorted(found)))
    return sorted(out, key=str)


def tables(spark, docs, items):
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
    )


def got(found):
    return sorted(((r.row.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found.collect()), key=str)


def sample(seed):
    random.seed(seed)
    letters = ["ab", "cd", "ef", "gh", "ij"]
    items = [(i, " ".join(random.choice(letters) for _ in range(random.randint(1, 25)))) for i in range(30)]
    items += [(90, None), (91, ""), (92, "..."), (None, "solo item without id"), (93, "Solo! item, without ID")]
    docs = []
    for i in range(60):
        parts = [random.choice(letters + ["zz", "yy"]) for _ in range(random.randint(0, 60))]
        parts[10:10] = words(random.choice(items)[1])[random.randint(0, 3) :]
        docs.append((i, ", ".join(parts)))
    docs += [(70, None), (71, ""), (72, "?!"), (73, "solo item without id"), (73, "solo item without id"), (74, "ab " * 9000)]
    return docs, [x for x in items if x[1] is None or len(words(x[1])) != 1]


def test_hits_match_brute_force(spark):
    docs, items = sample(1)
    a, b = tables(spark, docs, items)
    want = brute(docs, items)
    assert got(decontaminate.find_matches(a, b)) == want
    # Several blocks of items give the same rows.
    assert got(decontaminate.find_matches(a, b, block_bytes=200)) == want
    named = decontaminate.find_matches(a, b, block_bytes=200, keep=("doc_id",))
    assert got(named) == want and named.schema["row"].dataType.names == ["doc_id"]
    assert sorted(r.doc_id for r in decontaminate.clean_documents(a, b).collect()) == sorted(w[0] for w in want if not w[2])


def test_longest_matches_are_verbatim_and_maximal(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(1, "x " + " ".join(f"q{i}" for i in range(5, 22)) + " y"), (2, item), (3, "q1 q2 q3")]
    a, b = tables(spark, docs, [(7, item)])
    rows = {r.row.doc_id: r.matches for r in decontaminate.find_matches(a, b).collect()}
    assert [tuple(m) for m in rows[2]] == [(7, 0, 0, 30)]
    assert rows[3] == []
    assert all(m.length <= 17 for m in rows[1])


def test_empty_tables_and_clashing_columns(spark):
    a, b = tables(spark, [(1, "some text")], [(1, "some text")])
    assert decontaminate.find_matches(a.where("false"), b).count() == 0
    assert decontaminate.find_matches(a, b.where("false")).first().n_hit == 0
    clash = a.selectExpr("*", "'mine' as items", "1 as n_hit", "2 as hit")
    row = decontaminate.find_matches(clash, b).first()
    assert row.row["items"] == "mine" and row.n_hit == 2
    assert decontaminate.clean_documents(clash, b).columns == clash.columns
