"""Deep and nested paths: as many rounds as deciding forks, not as levels."""

import time

from tallyline.llm import urls


def judged(spark, found):
    rows = urls.judge(spark.createDataFrame(list(enumerate(found)), "page_id long, url string")).collect()
    return {r["page_id"]: (r["verdict"], r["template"]) for r in rows}


def test_nested_paths_are_passed_in_one_go(spark):
    deep = ["http://trap.net/" + "a/" * k for k in range(1, 801)] + ["http://trap.net/" + "b/" * 300 + f"{k}" for k in range(30)]
    began = time.time()
    got = judged(spark, deep)
    assert time.time() - began < 90
    assert len(got) == 830 and got[799][1] == "/" + "/".join(["a"] * 800) and got[0][1] == "/a" and got[805][1].endswith("/{n}")


def test_combs_of_paths_keep_their_steps(spark):
    comb = ["http://comb.net/" + "a/" * k + "b" for k in range(60)]
    got = judged(spark, comb)
    assert got[59][1] == "/" + "/".join(["a"] * 59 + ["b"]) and got[0][1] == "/b"
