"""Cleaning steps are computed once a row, however many later ones read them."""

from leadloom.operators import cleaning as C


def test_phone_steps_are_not_copied_into_each_other(spark):
    phones = ["(212) 2000001", "+1-212-2000002", "12122000003", "1+212", "++1 212 200 0004", "x", "", None]
    rows = C.clean_phones(spark.createDataFrame([(k, p) for k, p in enumerate(phones)], "id long, phone string"))
    got = {r.id: (r.phone_clean.value, r.phone_clean.changes) for r in rows.collect()}
    added, plus = "Added US country code", "Removed invalid + characters"
    assert [got[k] for k in range(5)] == [("+12122000001", [added]), ("+1-212-2000002".replace("-", ""), []), ("+12122000003", ["Added + prefix"]), ("1212", [plus]), ("+12122000004", [plus, "Added + prefix"])]
    assert [got[k][0] for k in (6, 7)] == ["", ""] and rows.columns == ["id", "phone", "phone_clean"]
    plan = rows.select("phone_clean")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") < 10
