import random

import pytest

from quillmill.operators import bibliography as B
from quillmill.sources import bibtex

SCHEMA = "entry_id long, side string, pos long, entry_type string, id string, fields map<string,string>"


def merged(spark, rows, **kw):
    df = spark.createDataFrame([(k, s, k, "article", i, f) for k, (s, i, f) in enumerate(rows)], SCHEMA)
    return {r.entry_id: r for r in B.merge(df, **kw).collect()}


def test_same_doi_keeps_the_base(spark):
    m = merged(spark, [("base", "k1", {"doi": "10.1/ABC"}), ("incoming", "k2", {"DOI": "https://doi.org/10.1/abc"})])
    assert [m[k].disposition for k in (0, 1)] == ["base", "dup"]


def test_policies(spark):
    rows = [("base", "K", {"title": "a"}), ("incoming", "k", {"title": "b"}), ("incoming", "k", {"title": "c"}), ("incoming", None, {})]
    fates = lambda p: [merged(spark, rows, policy=p)[k].disposition for k in range(4)]
    assert fates("keep-first") == ["base", "dup", "dup", "no_key"]
    assert fates("error") == ["base", "error", "error", "no_key"]
    assert fates("keep-second") == ["base", "replaced", "replaced", "no_key"]
    m = merged(spark, rows, policy="rename", suffix="_b")
    assert [m[k].new_id for k in (1, 2)] == ["k_b", "k_b2"]
    assert merged(spark, rows, policy="keep-second")[2].replaces == 0


def test_a_dropped_entry_publishes_nothing(spark):
    rows = [("incoming", "a", {"doi": "10.1/x"}), ("incoming", "b", {"doi": "10.1/x", "title": "T"}), ("incoming", "c", {"title": "T"})]
    m = merged(spark, rows)
    assert [m[k].disposition for k in range(3)] == ["added", "dup", "added"]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_give_what_one_fold_gives(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice(["base", "incoming"]), rng.choice(["a", "b", "c", "a_2", "d", ""]), {k: rng.choice("xyz") for k in ("title", "doi") if rng.random() < 0.6}) for _ in range(40)]
    for policy in B.POLICIES:
        m = merged(spark, rows, policy=policy)
        order = sorted(range(40), key=lambda k: (rows[k][0] != "base", k))
        flat = []
        for k in order:
            side, key, f = rows[k]
            tokens = [("key", key)] * bool(key) + [(m, f[m]) for m in ("doi", "title") if m in f]
            flat.append({"entry_id": k, "side": side, "pos": k, "id": key, "key": key, "canonical": str(sorted(f.items())), "tokens": tokens})
        for r in B.fold(flat, policy, "_2"):
            assert (m[r["entry_id"]].disposition, m[r["entry_id"]].new_id) == (r["disposition"], r["new_id"])


def test_empty_and_wrong_arguments(spark):
    assert B.merge(spark.createDataFrame([], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        B.dedupe_tokens(["key", "year"])
    with pytest.raises(ValueError):
        B.merge(spark.createDataFrame([], SCHEMA), policy="maybe")


def test_bibtex_source(spark, tmp_path):
    (tmp_path / "a.bib").write_text('@string{j = "Journal"}\n@comment{x}\n@Article{k1, title = {A {B} \\"{o}}, journal = j # " X", year = 1999}\n@weird{k2, note="n"}\n')
    (tmp_path / "b.bib").write_text("@article{k3, title = {open\n")
    rows = {(r.src, r.id): r for r in bibtex.read(spark, str(tmp_path), unicode=True).collect()}
    assert rows[("a.bib", "k1")].fields == {"title": "A B ö", "journal": "Journal X", "year": "1999"}
    assert rows[("a.bib", "k2")].pos == 1
    assert rows[("b.bib", None)].error
    kept = bibtex.read(spark, str(tmp_path), nonstandard=False).where("id is not null").collect()
    assert [r.id for r in kept] == ["k1"]


def test_first_wins_is_the_greedy_result_for_one_token(spark):
    rows = [(k, "incoming", k, "article", str(k), {"title": t}) for k, t in enumerate(["A b", "a B!", "", "c", ""])]
    r = B.first_wins(spark.createDataFrame(rows, SCHEMA), "title")
    assert {x.entry_id for x in r.where("is_first").collect()} == {0, 2, 3, 4}
