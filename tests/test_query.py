from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabulon.errors import ConstraintViolation, EntityNotFound, InvalidSchema, QueryFailed, ReadOnlyViolation
from tabulon.operators import fulltext as fts
from tabulon.operators import match_text
from tabulon.operators import mutations as mut
from tabulon.operators.predicates import Columns, key_in, raw, sql_literal
from tabulon.operators.query import query
from tabulon.schema import Entity, Field, ForeignKey, FullTextIndex, Nested, camel_case, snake_case

S, L, TS = T.StringType(), T.LongType(), T.TimestampType()
NOW = datetime(2024, 1, 1)
USER = Entity(
    "user",
    [Field("id", L), Field("name", S), Field("age", L, nullable=True), Field("address", S, default="{}"), Field("created_at", TS, default_sql="current_timestamp()"), Field("updated_at", TS, default_sql="current_timestamp()")],
    ["id"],
    nested=[Nested("address.city"), Nested("address.zip", L)],
    indexes=[FullTextIndex(("name", "address.city"))],
)


def users(spark, rows):
    data = [(i, n, a, j, NOW, NOW) for i, n, a, j in rows]
    return spark.createDataFrame(data, USER.struct_type())


@pytest.fixture(scope="module")
def people(spark):
    return users(spark, [(i, f"User{i}", 20 + i if i else None, f'{{"city": "Café {i}", "zip": {i * 10}}}') for i in range(10)])


def test_names():
    assert snake_case("createdAt") == "created_at" and snake_case("userID") == "user_i_d" and camel_case("created_at") == "createdAt"


def test_declarations_are_checked():
    with pytest.raises(InvalidSchema):
        Entity("x", [Field("id", L)], ["id"])  # no timestamps
    with pytest.raises(InvalidSchema):
        Entity("x", [Field("id", L, nullable=True)], ["id"], timestamps=False)
    with pytest.raises(InvalidSchema):
        Entity("x", [Field("id", L), Field("ID", L)], ["id"], timestamps=False)
    with pytest.raises(InvalidSchema):
        Entity("x", [Field("id", L), Field("n", L)], ["id"], timestamps=False, indexes=[FullTextIndex(("n",))])
    assert Entity("x", [Field("id", S)], ["id"], readonly=True).struct_type() == T.StructType([T.StructField("id", S, False)])


def test_unmapped_property_is_an_error_at_once(people):
    with pytest.raises(InvalidSchema):
        query(USER, people).filter(lambda c: c.nothing == 1)
    with pytest.raises(InvalidSchema):
        query(USER, people).select("nothing")


def test_chain_and_paging(people):
    q = query(USER, people).filter(lambda c: c.age >= 25).order_desc("age")
    assert [r.age for r in q.limit(3).select("age").all()] == [29, 28, 27]
    assert [r.age for r in q.limit(9).offset(3).limit(1).select("age").all()] == [26]
    assert q.first().age == 29 and q.count() == 5


def test_three_valued_logic(people):
    q = query(USER, people)
    assert q.filter(lambda c: c.age != 25).count() == 8  # null isn't unequal
    assert q.filter(lambda c: ~(c.age > 25)).count() == 5
    assert q.filter(lambda c: c.age == None).count() == 1  # noqa: E711
    assert q.filter(lambda c: c.age.not_in([])).count() == 10 and q.filter(lambda c: c.age.is_in([])).is_empty()
    assert q.filter(lambda c: (c.age == 21) | (c.age == 22)).filter(lambda c: c.id > 1).count() == 1


def test_like_is_ascii_only_and_has_no_escape(spark):
    df = users(spark, [(1, "Äb", 1, "{}"), (2, "a\\b", 1, "{}"), (3, "A%b", 1, "{}")])
    q = query(USER, df)
    assert [r.id for r in q.filter(lambda c: c.name.like("äb")).all()] == []
    assert [r.id for r in q.filter(lambda c: c.name.like("A\\B")).all()] == [2]
    assert sorted(r.id for r in q.filter(lambda c: c.name.contains("%b")).all()) == [1, 2, 3]


def test_nested_columns(people):
    q = query(USER, people)
    assert q.filter(lambda c: c["address.zip"] > 60).count() == 3
    text = Entity("user", USER.fields, ["id"], nested=[Nested("address.zip", L, text_affinity=True)])
    assert query(text, people).filter(lambda c: c["address.zip"] > "60").count() == 3 + 0


def test_keys(people):
    q = query(USER, people)
    assert q.by_id(3).first().id == 3 and q.by_ids([1, 2, 99]).count() == 2 and q.by_ids([]).is_empty()
    assert key_in(people, USER, range(2000)).count() == 10
    two = Entity("t", [Field("id", L), Field("name", S)], ["id", "name"], timestamps=False)
    assert key_in(people, two, [(1, "User1"), (2, "no")]).count() == 1
    assert key_in(people, two, [(i, f"User{i}") for i in range(30)]).count() == 10


def test_aggregates_ignore_paging(people):
    q = query(USER, people).order("id").limit(2).offset(5)
    assert (q.count(), q.min("age"), q.max("age"), q.sum("age"), q.avg("age")) == (10, 21, 29, 225, 25.0)
    none = q.filter(F.lit(False))
    assert (none.count(), none.min("age"), none.sum("age"), none.avg("age")) == (0, None, 0, None)
    assert query(USER, people).select("name").distinct().count() == 10


def test_get_and_ambiguous_columns(people):
    with pytest.raises(EntityNotFound):
        query(USER, people).by_id(77).get()
    with pytest.raises(QueryFailed):
        query(USER, people).select("id", "id")


def test_raw_predicates(people):
    assert query(USER, people).filter(raw("age > ? AND name <> '?'", [27])).count() == 2
    with pytest.raises(ValueError):
        raw("a = ?", [])
    assert sql_literal("it's \\") == "'it\\'s \\\\'" and sql_literal(None) == "NULL" and sql_literal(b"\x01") == "X'01'"


def test_full_text(people):
    q = query(USER, people)
    assert q.search("cafe").count() == 10 and q.search("  ").is_empty() and q.search("CAFÉ 3").first().id == 3
    assert q.matching(fts.In(fts.Term("user3"), ("name",))).count() == 1
    assert q.matching(fts.In(fts.Term("user3"), ("address.city",))).is_empty()
    assert q.matching(fts.Prefix("use")).count() == 10
    assert q.matching(fts.Term("cafe") - fts.Term("3")).count() == 9
    with pytest.raises(QueryFailed):
        q.search("x", "no_such_index")


def test_rank_comes_first(spark):
    df = users(spark, [(1, "swift", 1, "{}"), (2, "swift swift and more words here", 1, "{}"), (3, "swift", 1, "{}"), (4, "none", 1, "{}")])
    q = query(USER, df).matching(fts.Term("swift")).order_desc("id").order_by_rank(fts.Term("swift"))
    ids = [r.id for r in q.all()]
    assert sorted(ids) == [1, 2, 3] and ids.index(3) < ids.index(1)


def test_near_porter_and_substring(spark):
    e = Entity("d", [Field("id", L), Field("t", S, True)], ["id"], timestamps=False, indexes=[FullTextIndex(("t",), "p", "porter"), FullTextIndex(("t",), "s", "trigram"), FullTextIndex(("t",), "u")])
    df = spark.createDataFrame([(1, "running dogs chase a ball"), (2, "he runs"), (3, None)], "id long, t string")
    q = query(e, df)
    assert sorted(r.id for r in q.search("run", "p").all()) == [1, 2] and q.search("run", "u").is_empty()
    assert q.search("nni", "s").count() == 1 and q.search("ru", "s").is_empty()
    assert q.matching(fts.Near("running", "ball", 3), "u").count() == 1 and q.matching(fts.Near("ball", "running", 2), "u").is_empty()


def test_postings_follow_changes(spark):
    e = Entity("d", [Field("id", L), Field("t", S, True)], ["id"], timestamps=False, indexes=[FullTextIndex(("t",))])
    old = spark.createDataFrame([(1, "a b a"), (2, "b"), (3, None)], "id long, t string")
    new = spark.createDataFrame([(1, "a b a"), (2, "c"), (4, "a")], "id long, t string")
    posts = fts.postings(old, e)
    assert sorted((r.term, r.id, r.tf, r.positions) for r in posts.collect()) == [("a", 1, 2, [0, 2]), ("b", 1, 1, [1]), ("b", 2, 1, [0])]
    after = fts.refreshed_postings(posts, old, new, e)
    assert fts.check_postings(after, new, e).isEmpty() and not fts.check_postings(posts, new, e).isEmpty()
    assert [r.id for r in fts.find_terms(after, e, ["a", "b"]).collect()] == [1]


DOC = Entity("d", [Field("id", L), Field("t", S, True), Field("u", S, True)], ["id"], timestamps=False, indexes=[FullTextIndex(("t", "u")), FullTextIndex(("t",), "p", "porter")])
DOCS = [(1, "swift swift and more words", "x"), (2, "Swiftly he goes", "swift"), (3, None, None), (4, "he, the swifter: more", "words more"), (5, "Éclair things", "a b a b a")]
MATCHES = [
    fts.Term("swift"), fts.Prefix("swi"), fts.Prefix("more wo"), fts.Phrase("swift and more"), fts.Phrase("b a b"), fts.First("swift"), fts.FirstPrefix("swi"), fts.Near("swift", "words", 2), fts.Near("he", "more", 1),
    fts.In(fts.Term("swift"), ("u",)), fts.In(fts.Prefix("swi"), ("t",)) | fts.Term("eclair"), fts.Term("more") - fts.Term("he"), (fts.Term("more") & fts.Prefix("w")) | fts.First("ecl"), fts.Phrase(" ,"),
]


@pytest.mark.parametrize("match", MATCHES, ids=str)
def test_stored_index_finds_and_ranks_as_texts_do(spark, match):
    df = spark.createDataFrame(DOCS, "id long, t string, u string")
    posts, lengths = fts.postings(df, DOC, "d_fts"), fts.row_lengths(df, DOC, "d_fts")
    want = {r.id: r.rank for r in fts.with_rank(df, df, DOC, match, "d_fts", (2.0,)).filter("rank is not null").collect()}
    got = {r.id: r.rank for r in fts.find(posts, lengths, DOC, match, "d_fts", (2.0,)).collect()}
    assert got.keys() == want.keys() == {r.id for r in fts.matching(df, DOC, match, "d_fts").collect()}
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want) and all(x < 0 for x in want.values())


def test_prefixes_rank(spark):
    df = spark.createDataFrame([(1, "swiss cheese", ""), (2, "other swift swim swish", ""), (3, "nothing", ""), (4, "no", ""), (5, "none", "")], "id long, t string, u string")
    q = query(DOC, df)
    m = fts.Prefix("swi") | fts.Term("other")
    assert [r.id for r in q.matching(m, "d_fts").order_by_rank(m, "d_fts").all()] == [2, 1]


def test_porter_terms_and_candidates(spark):
    df = spark.createDataFrame([(1, "hopping happily", ""), (2, "relational things", ""), (3, "sensibility of the thing", ""), (4, "hoping", "")], "id long, t string, u string")
    posts = fts.postings(df, DOC, "p")
    assert sorted(r.id for r in fts.find_terms(posts, DOC, ["things"], index="p").collect()) == [2, 3]
    for word, ids in (("relation", [2]), ("real", []), ("happily", [1]), ("hop", [1]), ("hope", [4]), ("sensible", [3]), ("thing", [2, 3])):
        assert sorted(r.id for r in query(DOC, df).search(word, "p").all()) == ids, word
    assert sorted(r.id for r in fts.find(posts, fts.row_lengths(df, DOC, "p"), DOC, fts.Term("things") - fts.Term("relate"), "p").collect()) == [3]


def test_lengths_follow_changes(spark):
    old = spark.createDataFrame(DOCS, "id long, t string, u string")
    new = spark.createDataFrame([*DOCS[1:], (9, "one two", None)], "id long, t string, u string")
    after = fts.refreshed_lengths(fts.row_lengths(old, DOC, "d_fts"), old, new, DOC, "d_fts")
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, fts.row_lengths(new, DOC, "d_fts").collect()))


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("swift", fts.Phrase("swift")),
        ('"a ""b"" c"', fts.Phrase('a "b" c')),
        ("swi*", fts.Prefix("swi")),
        ('"more wo" *', fts.Prefix("more wo")),
        ("^ one + two*", fts.FirstPrefix("one two")),
        ("^one", fts.First("one")),
        ("a b", fts.Phrase("a") & fts.Phrase("b")),
        ("a OR b AND c NOT d", fts.Phrase("a") | (fts.Phrase("b") & (fts.Phrase("c") - fts.Phrase("d")))),
        ("(a OR b) c", (fts.Phrase("a") | fts.Phrase("b")) & fts.Phrase("c")),
        ("t : a", fts.In(fts.Phrase("a"), ("t",))),
        ("t: swi* OR other", fts.In(fts.Prefix("swi"), ("t",)) | fts.Phrase("other")),
        ("{t U}: (a b)", fts.In(fts.Phrase("a") & fts.Phrase("b"), ("t", "u"))),
        ("- t : a", fts.In(fts.Phrase("a"), ("u",))),
        ('NEAR(a "b c", 3)', fts.Near("a", "b c", 3)),
        ("NEAR(a b)", fts.Near("a", "b", 10)),
        ("  ", fts.Phrase("")),
        ("not or near", fts.Phrase("not") & fts.Phrase("or") & fts.Phrase("near")),
        ("été", fts.Phrase("été")),
    ],
)
def test_match_text(text, want):
    assert match_text.parse(text, ("t", "u")) == want


@pytest.mark.parametrize("text", ['"a', "a OR", "AND a", "(a", "a)", "a AND OR b", "x: a", "t:", "NEAR(a b", "NEAR(a b, c)", "a +", "*", "a NOT", "{t a", "a ; b", "- t a"])
def test_malformed_match_text(text):
    with pytest.raises(QueryFailed):
        match_text.parse(text, ("t", "u"))


def test_update_and_delete(people):
    q = query(USER, people)
    hit = q.filter(lambda c: c.age >= 23)
    new = mut.update_all(hit.limit(1), {"age": mut.Assign.plus(100), "name": Columns(USER).address})
    assert mut.affected(hit) == 7 and new.filter("age > 100").count() == 7 and new.filter("name like '%city%'").count() == 7
    assert new.filter("updated_at = created_at").count() == 3
    assert mut.delete_all(hit).count() == 3  # the row with a null age stays
    assert mut.update_all(q, {}).exceptAll(people).isEmpty()
    kept = mut.update_all(q.by_ids([1]), {"updated_at": F.lit(NOW), "age": None})
    assert kept.filter("age is null").count() == 2


def test_insert_save_update_delete(spark, people):
    new = users(spark, [(3, "X", 1, "{}"), (50, "Y", 1, "{}")])
    with pytest.raises(ConstraintViolation):
        mut.insert(USER, people, new)
    assert mut.insert(USER, people, new.filter("id = 50").select("id", "name")).count() == 11
    saved = mut.save(USER, people, new)
    assert saved.count() == 11 and saved.filter("id = 3").first().name == "X"
    with pytest.raises(EntityNotFound):
        mut.update(USER, people, new)
    assert mut.delete(USER, people, new.select("id")).count() == 9 and mut.delete_id(USER, people, 99).count() == 10
    with pytest.raises(ReadOnlyViolation):
        mut.save(Entity("r", [Field("id", L)], ["id"], readonly=True), people, new)


def test_violations(spark):
    e = Entity("c", [Field("id", L), Field("p", L, True), Field("u", S, True, unique=True)], ["id"], timestamps=False, foreign_keys=[ForeignKey(("p",), "parent", ("k",))])
    df = spark.createDataFrame([(1, 1, "a"), (1, 9, "a"), (None, None, None)], "id long, p long, u string")
    parent = spark.createDataFrame([(1,)], "k long")
    found = {(r.rule, r.detail, r.rows) for r in mut.violations(e, df, {"parent": parent}).collect()}
    assert found == {("not null", "id", 1), ("key", "id", 1), ("unique", "u", 1), ("foreign key", "parent", 1)}
    with pytest.raises(ConstraintViolation):
        mut.require(e, df)


def test_decode_with_defaults(spark):
    e = Entity("d", [Field("id", L), Field("n", L, default=7), Field("s", S, True, default="x")], ["id"], timestamps=False)
    df = spark.createDataFrame([('{"id": 1, "n": "no", "s": "y"}',), ('{"id": 2}',)], "j string")
    assert sorted(tuple(r) for r in e.from_json(df, "j").collect()) == [(1, 7, "y"), (2, 7, None)]
    with pytest.raises(Exception, match="decoded"):
        e.from_json(spark.createDataFrame([("{}",)], "j string"), "j").collect()
