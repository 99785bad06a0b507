"""Questions in two languages and with filters, against readings made by hand."""

from __future__ import annotations

from lodestone.operators import questions
from lodestone.plans.wording import INTENT_WORDINGS


def test_every_wording_of_an_intent_goes_to_the_tables(spark):
    rows = [(intent, text.replace("%d", "2025")) for intent, texts in INTENT_WORDINGS.items() for text in texts]
    assert len(rows) == 39
    read = questions.intent(questions.route(spark.createDataFrame(rows, "want string, question string"))).collect()
    assert [(r.question, r.intent, r.route) for r in read if (r.intent, r.route) != (r.want, "sql")] == []


def test_years_names_and_kinds_in_both_languages(spark):
    cases = [
        ("antara 2020 dan 2018", ("between", 2018, 2020), None, None, "combined"),
        ("dari 2019 hingga 2021", ("between", 2019, 2021), None, None, "combined"),
        ("2019 sampai 2021", ("between", 2019, 2021), None, None, "combined"),
        ("sejak tahun 2015", ("gte", 2015, None), None, None, "combined"),
        ("sebelum 2015", ("lte", None, 2015), None, None, "combined"),
        ("tren tahun 1850", (None, None, None), None, None, "trends"),
        ("publikasi oleh Yanti Rahayu di 2020", ("eq", 2020, 2020), "Yanti Rahayu", None, "combined"),
        ("pakar dari Universitas Udayana", (None, None, None), None, "Udayana", "experts"),
        ("perkembangan riset dan siapa pakarnya", (None, None, None), None, None, "combined"),
    ]
    read = questions.read(spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "k int, question string")).collect()
    assert {r.k: (r.question, (r.year_op, r.year_from, r.year_to), r.author_name, r.institution_name, r.hybrid_kind) for r in read} == dict(enumerate(cases))


def test_topic_words_end_before_time_and_filters_win(spark):
    asked = ["tren topik Coumarin setelah 2020", "What about gene editing?", "on", "nothing here", None]
    got = questions.topic_words(spark.createDataFrame([(i, a) for i, a in enumerate(asked)], "k int, question string")).collect()
    assert {r.k: r.topic_words for r in got} == {0: "Coumarin", 1: "gene editing", 2: None, 3: None, 4: None}
    given = spark.createDataFrame([("about soil", " T ", None), ("about soil", "", "K"), ("about soil", None, None)], "question string, topic_name string, keyword string")
    assert [r.topic_words for r in questions.topic_words(given).collect()] == ["T", "K", "soil"]


def test_category_means_keep_negatives_apart(spark):
    from lodestone.operators import evaluate

    columns = "query_id int, shown int, relevant int, precision double, recall double, recall_ceiling double, hit int, mrr double, ndcg double"
    metrics = spark.createDataFrame([(1, 8, 2, 0.5, 1.0, 1.0, 1, 1.0, 0.8), (2, 4, 0, 0.0, 0.0, 0.0, 0, 0.0, 0.0), (3, 0, 0, 0.0, 0.0, 0.0, 0, 0.0, 0.0), (4, 2, 4, 0.25, 0.5, 1.0, 1, 0.5, 0.4)], columns)
    about = spark.createDataFrame([(1, "a", True, 0.9), (2, "a", False, 0.6), (3, "b", False, 0.2), (4, None, True, 0.5)], "query_id int, category string, has_answer boolean, top_similarity double")
    got = {r.category: r for r in evaluate.category_means(metrics, about).collect()}
    assert got.keys() == {"a", "b", "", None}  # a query without a category is apart from the row over all
    assert (got["a"].queries, got["a"].positives, got["a"].false_positives, got["a"].ndcg, got["a"].false_positive_rate) == (2, 1, 1, 0.8, 1.0)
    assert (got["b"].positives, got["b"].ndcg, got["b"].false_positive_rate, got["b"].mean_top_similarity_negative) == (0, 0.0, 0.0, 0.2)
    assert (got[None].queries, got[None].ndcg, got[None].precision, got[None].false_positive_rate, got[None].mean_shown) == (4, 0.6, 0.375, 0.5, 5.0)
