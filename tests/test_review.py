"""Batch review."""

from briefkit.operators import review

REG = [("a", "https://a.com", False), ("e", "https://e.com?utm_x", False), ("d", "https://d.com", False),
       ("s", "https://s.com", False), ("u", "https://u.com", False), ("v", "https://v.com", True),
       ("nodecision", "https://n.com", False)]
DEC = [("a", " A ", None), ("e", "e", "  https://e.com  "), ("d", "D", None), ("s", "s", None),
       ("u", "zzz", None), ("v", "d", None), ("ghost", "a", None)]


def frames(spark):
    reg = spark.createDataFrame(REG, "name string, url string, verified boolean")
    dec = spark.createDataFrame(DEC, "name string, action string, new_url string")
    return reg, dec


def test_queue(spark):
    reg, _ = frames(spark)
    assert sorted(r.name for r in review.review_queue(reg).collect()) == ["a", "d", "e", "nodecision", "s", "u"]


def test_apply(spark):
    reg, dec = frames(spark)
    out = {r.name: (r.url, r.verified, r.changed) for r in review.apply_decisions(reg, dec).collect()}
    assert out == {
        "a": ("https://a.com", True, True),
        "e": ("https://e.com", True, True),
        "s": ("https://s.com", False, False),
        "u": ("https://u.com", False, False),
        "v": ("https://v.com", True, False),          # verified rows are never touched
        "nodecision": ("https://n.com", False, False),
    }
    s = review.review_summary(reg, dec).first()
    assert (s.n_accepted, s.n_edited, s.n_deleted, s.changed) == (1, 1, 1, True)


def test_apply_is_idempotent(spark):
    reg, dec = frames(spark)
    once = review.apply_decisions(reg, dec).drop("changed")
    twice = review.apply_decisions(once, dec).drop("changed")
    assert sorted(once.collect()) == sorted(twice.collect())
    assert review.review_summary(once, dec).first().changed is False
