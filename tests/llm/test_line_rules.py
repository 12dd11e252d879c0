"""Bars and guillemets in prose are not navigation."""

from tracewright.llm import quality_rules


def test_navigation_needs_short_items(spark):
    half = "the words of this half go on for a while, as words of prose do"
    lines = {
        f"{half} | {half} | {half}.": True,
        f"{half} • {half} • {half}.": True,
        "Il a dit « bonjour » et puis « bonsoir » à tous.": True,
        "Er sagte »ja« und dann »nein« zu allen.": True,
        "menu | home | about | us": False,
        "Home » News » Sport": False,
        "Home › News › « Le sport »": False,
        "Home → News → Sport of the day": False,
    }
    rows = spark.createDataFrame([(line,) for line in lines], "line string").select("line", quality_rules.good_line(quality_rules.F.col("line")).alias("good")).collect()
    assert {r["line"]: r["good"] for r in rows} == lines


def test_clean_text_of_one_line_is_kept(spark):
    text = "Elle répond « oui » puis « non » " + " ".join(f"mot{i}" for i in range(40)) + "."
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    assert quality_rules.clean(df).count() == 1
