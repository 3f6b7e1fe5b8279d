from tasteloom.operators import quality as q
from tasteloom.operators.quality import ColumnRule, TableRules


def by_column(report):
    return {(r["check"], r["column"]): r for r in report.collect()}


def test_clean_table_passes(spark):
    movies = spark.createDataFrame([(1, "A", "Action"), (2, "B", "Comedy")], "MovieID int, Title string, Genres string")
    rules = TableRules(
        {"MovieID": ColumnRule("integer", nullable=False, min=1, max=3952), "Title": ColumnRule("string", min_length=1),
         "Genres": ColumnRule("string", valid_values=["Action", "Comedy"])},
        primary_key=["MovieID"],
    )
    report = q.validate("movies", movies, rules)
    assert {r.status for r in report.collect()} == {q.PASSED}
    assert q.overall_status(report).first().status == q.PASSED


def test_null_bad_value_and_missing_column(spark):
    users = spark.createDataFrame([(1, "M"), (None, "F"), (3, "X")], "UserID int, Gender string")
    rules = TableRules({"UserID": ColumnRule("integer", nullable=False), "Gender": ColumnRule("string", valid_values=["M", "F"]), "Age": ColumnRule("integer")})
    schema = by_column(q.run_checks(users, "users", q.schema_checks(users, rules)))
    assert schema[("column_present", "Age")]["status"] == q.FAILED
    assert by_column(q.run_checks(users, "users", q.null_checks(rules)))[("nullability", "UserID")]["violations"] == 1
    assert by_column(q.run_checks(users, "users", q.value_checks(rules)))[("allowed_values", "Gender")]["violations"] == 1


def test_type_mismatch_and_extra_column_warn(spark):
    df = spark.createDataFrame([("1", 2)], "UserID string, Extra int")
    rows = by_column(q.run_checks(df, "u", q.schema_checks(df, TableRules({"UserID": ColumnRule("integer")}))))
    assert rows[("column_type", "UserID")]["status"] == q.WARNED
    assert rows[("unexpected_columns", "Extra")]["violations"] == 1


def test_multi_genre_with_and_without_split(spark):
    df = spark.createDataFrame([("Action|Comedy",), ("Action|Nope",)], "Genres string")
    values = ["Action", "Comedy"]
    for split, expected in (("|", 1), (None, 2)):
        rules = TableRules({"Genres": ColumnRule(valid_values=values, split=split)})
        assert q.run_checks(df, "m", q.value_checks(rules)).first().violations == expected


def test_step_is_symmetric(spark):
    df = spark.createDataFrame([(0.5,), (1.0,), (2.5,), (2.7,), (0.1 + 0.2 + 0.2,)], "Rating double")
    assert q.run_checks(df, "r", q.step_checks(TableRules({"Rating": ColumnRule(step=0.5)}))).first().violations == 1


def test_orphans_count_keys_and_rows(spark):
    ratings = spark.createDataFrame([(1,), (2,), (3,), (999,), (999,), (None,)], "MovieID int")
    movies = spark.createDataFrame([(1,), (2,), (3,)], "MovieID int")
    rows = by_column(q.foreign_key_check("ratings", ratings, "MovieID", movies, "MovieID"))
    assert (rows[("foreign_key_keys", "MovieID")]["violations"], rows[("foreign_key_keys", "MovieID")]["observed"]) == (1, 0.75)
    assert (rows[("foreign_key_rows", "MovieID")]["violations"], rows[("foreign_key_rows", "MovieID")]["observed"]) == (2, 0.6)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "UserID int")
    assert q.uniqueness_check("u", empty, ["UserID"]).first().status == q.PASSED
    assert q.foreign_key_check("u", empty, "UserID", empty, "UserID").first().status == q.PASSED
    assert by_column(q.stage_suite("raw", "u", empty, ["UserID"]))[("row_count", "*")]["status"] == q.FAILED


def test_null_tiers(spark):
    df = spark.createDataFrame([(i, None if i == 0 else 1.0, None if i < 3 else 1.0) for i in range(20)], "id int, a double, b double")
    status = {r.column: r.status for r in q.feature_nulls("users", df, warn_below=True).collect()}
    assert status == {"id": q.PASSED, "a": q.WARNED, "b": q.FAILED}
    assert {r.column: r.status for r in q.feature_nulls("movies", df).collect()}["a"] == q.PASSED


def test_constant_feature_fails_and_few_rows_warn(spark):
    users = spark.createDataFrame([(i, 1.0) for i in range(5)], "UserID int, AvgRating double")
    inter = spark.createDataFrame([(i, float(i), float(2 * i)) for i in range(5)], "UserID int, a double, b double")
    rows = {(r.check, r.column): r for r in q.feature_statistics(users, inter, ["UserID", "AvgRating"], ["a", "b"], max_pairs=0).collect()}
    assert rows[("feature_spread", "AvgRating")].status == q.FAILED
    assert rows[("collinear_pairs", "*")].violations == 1 and rows[("collinear_pairs", "*")].status == q.WARNED
    low = {r.check: r.status for r in q.feature_consistency(inter, users.filter("UserID < 3"), "UserID").collect()}
    assert low == {"ids_missing": q.WARNED, "cardinality": q.WARNED}
