from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarn.plans.scope import DENY, UNRESTRICTED, Authority, Scope, effective

paths = st.lists(st.sampled_from(["a", "b", "grant", "grant-two", "x"]), max_size=3).map(lambda p: "/" + "/".join(p))
scopes = st.one_of(st.just(UNRESTRICTED), st.lists(paths, max_size=3).map(lambda p: Scope.of(*p)))


def test_prefixes_are_whole_components():
    scope = Scope.of("/grant")
    assert scope.allows("/grant") and scope.allows("/grant/sub") and not scope.allows("/grant-two") and not scope.allows("/g")
    assert not DENY.allows("/") and UNRESTRICTED.allows("/x") and Scope.of("/").allows("/x")


@given(scopes, scopes, paths)
def test_intersection_allows_what_both_allow(a, b, path):
    assert a.intersect(b).allows(path) == (a.allows(path) and b.allows(path))


def test_requests_narrow(spark):
    assert effective("/a/b", Scope.of("/a")) == Scope.of("/a/b")
    assert effective("/a", Scope.of("/a/b")) == Scope.of("/a/b")
    assert effective("/c", Scope.of("/a")).denies_all
    rows = spark.createDataFrame([("/grant",), ("/grant/sub",), ("/grant-two",), ("/grant0",)], "path string")
    assert {r[0] for r in rows.where(Scope.of("/grant").column()).collect()} == {"/grant", "/grant/sub"}
    assert rows.where(DENY.column()).count() == 0 and rows.where(UNRESTRICTED.column(F.col("path"))).count() == 4


def test_authority():
    who = Authority("s3cret", {"ann": Scope.of("/a")})
    assert who.resolve(token="s3cret") == UNRESTRICTED
    assert who.resolve("ann") == Scope.of("/a") and who.resolve("bob") == DENY and who.resolve() == DENY
    assert who.resolve("ann", "wrong") == Scope.of("/a") and who.resolve("ann", restrict_to=["/a/b"]) == Scope.of("/a/b")
    assert who.resolve(token="s3cret", restrict_to=["/q"]) == Scope.of("/q")
