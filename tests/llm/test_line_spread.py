from sangloc.llm import line_spread
from sangloc.llm.queries import op5_line_spread
from tools_check import compare, connect


def by_hand(rows, min_sites):
    sites, keeper = {}, {}
    for key, text, site in rows:
        for line in (text or "").split("\n"):
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).update([site] if site is not None else [])
                if key is not None:
                    keeper[line.strip(" ")] = min(key, keeper.get(line.strip(" "), key))
    out = []
    for key, text, _ in rows:
        if text is None:
            out.append((key, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if len(sites.get(x.strip(" "), ())) < min_sites or keeper.get(x.strip(" ")) == key]
        out.append((key, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def test_against_plain_python(spark):
    rows = [(i, f"own {i}\n  menu \nshared {i % 3}\n\nnear {i // 4}", f"s{i % 12}") for i in range(60)]
    rows += [(100, None, "s1"), (101, "", "s2"), (102, "menu", None), (102, "menu\nmenu", "s3"), (None, "menu\nx", "s4"), (103, "menu\n" * 5000, "s5")]
    docs = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, source string, n_lines int, _key string")
    for min_sites in (2, 4, 12, 13):
        got = line_spread.without_boilerplate(docs, min_sites=min_sites)
        got = sorted(((r.doc_id, r.text, r.n_lines, r.n_removed) for r in got.collect()), key=str)
        assert got == by_hand(rows, min_sites)
    assert line_spread.without_boilerplate(docs.limit(0)).count() == 0


def test_query_against_duckdb(spark, folder):
    for where in (folder, "/root/testdata/sf0.01"):
        con = connect(where)
        result = compare(spark, con, where, "op5_line_spread")
        assert result.startswith("ok"), result


def test_lines_are_removed_at_all(spark):
    got = op5_line_spread(spark, "/root/testdata/sf0.01").agg({"n_removed": "sum"}).collect()
    assert got[0][0] > 100


def test_clashing_columns_and_repeated_keys_with_other_texts(spark):
    """Columns of any name come along; rows that repeat a key lose their own lines."""
    rows = [(i, f"common\nown {i}\ncommon", f"s{i}", i, "x", "y") for i in range(12)] + [(5, "other\ncommon", "s5", 0, "x", "y"), (6, None, "s6", 0, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, _gone long, _gone_key string, _kept string")
    out = line_spread.without_boilerplate(docs)
    assert set(docs.columns) < set(out.columns)
    got = sorted((r.doc_id, r.text, r.n_lines, r.n_removed, r._gone, r._kept) for r in out.where("text IS NOT NULL").collect())
    want = sorted((i, f"own {i}" if i else t, 3, 2 if i else 0, g, k) for i, t, _, g, _, k in rows[:12])
    assert got == sorted(want + [(5, "other", 2, 1, 0, "y")])


def test_very_many_lines_in_a_row(spark):
    lines = [f"line {i}" for i in range(20_000)]
    rows = [(i, "\n".join(lines), f"s{i}") for i in range(11)]
    out = line_spread.without_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r.doc_id, r.n_removed, r.text == "") for r in out.collect()) == [(i, 20_000 if i else 0, bool(i)) for i in range(11)]
