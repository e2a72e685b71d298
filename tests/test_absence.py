import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelweave.operators import label_columns
from panelweave.plans import feature_columns, split_features
from panelweave.plans import absence as ab

D = dt.date


@pytest.fixture(scope="module")
def inputs(spark):
    months = [D(2018 + i // 12, i % 12 + 1, 1) for i in range(15)]
    snapshot = [
        (e, m, int(e == 1 and m.month == 3), 1980, "мужской" if e == 1 else "женский", "Рабочий",
         "Высшее-бакалавриат" if e == 1 else "Иное", "5", "6", 4.0 * e, 1.0, 1.0, 1, 10.0, "A", "B", "C")
        for e in (1, 2)
        for m in months
    ]
    log = [(1, D(2017, 12, 5), "Смена 1", "7,5", "Явка", None)]
    for m in months:
        log += [(e, m.replace(day=5), "Смена 1", "7,5", "Явка", None) for e in (1, 2)]
        if m.month == 2:
            log.append((1, m.replace(day=28), None, None, "Больничный", "Б"))
    weather = [(m, float(m)) for m in range(1, 13)]
    return (
        spark.createDataFrame(snapshot, ab.SNAPSHOT_SCHEMA),
        spark.createDataFrame([(2, "Дочь", 2015), (2, "Мать", 1950)], ab.DEPENDENTS_SCHEMA),
        spark.createDataFrame(log, ab.LOG_SCHEMA),
        spark.createDataFrame(weather, "`Месяц` int, `Темп Средняя` double"),
    )


def test_panel_of_every_feature(inputs):
    panel = ab.absence_panel(*inputs).cache()
    assert panel.count() == 30
    names = set(panel.columns)
    assert {
        "work_shift_type_count_rolling_mean_3", "sum_work_hours_cummean", "trend_sick_2_24",
        "cnt_days_graphic_rule_level_1_Bolnichnyj_rolling_max_6", "name_post_lvl4_people_count",
        "trend_std_name_fact_lvl4_sick_avg_2_6", "is_last_day", "rale_is_old", "young_children_6_cnt",
        "personel_num", "work_experience_all_stage_1", "category_Rabochij", "education_Vysshee",
        "Temp_Srednjaja", "month_7", "year_2019", "age", "gender", "y_12",
    } <= names
    assert not names & {"name_fact_lvl5", "_idx", "_own_flag", "date_of_birth"}

    rows = {(r["hash_tab_num"], r["date"]): r for r in panel.collect()}
    feb, jan = rows[1, D(2018, 2, 1)], rows[1, D(2018, 1, 1)]
    assert (feb["sick"], feb["is_last_day"], jan["sick"], jan["y_1"], jan["y_2"]) == (1, 1, 0, 1, 0)
    # The log's month before the snapshot begins counts in the log's own history.
    assert jan["work_shift_type_count_cummean"] == 1 and jan["sum_work_hours_rolling_std_2"] == 0
    assert jan["trend_sum_work_hours_2_24"] == 1
    child = rows[2, D(2018, 5, 1)]
    assert (child["rale_is_old"], child["young_children_6_cnt"], child["young_children_6_female_cnt"]) == (1, 1, 1)
    assert child["personel_num"] == 3 and child["name_post_lvl4_people_count"] == 2
    assert rows[1, D(2018, 3, 1)]["name_post_lvl4_sick_avg"] == 0.5
    assert (feb["gender"], feb["age"], feb["education_Vysshee"]) == (1, 38, 1)
    assert child["education_Nachalnoe_srednee"] == 1 and child["Temp_Srednjaja"] == 5.0
    assert rows[1, D(2019, 3, 1)]["y_1"] is None

    dummies = [c for c in panel.columns if c.startswith("month_")]
    assert panel.where(sum(F.col(c) for c in dummies) != 1).count() == 0
    x, y = split_features(panel, ab.ABSENCE)
    assert x.columns[2:] == feature_columns(panel, ab.ABSENCE)
    assert y.columns == ["hash_tab_num", "date", *label_columns()]


def test_repeated_snapshot_month_fails(inputs):
    snapshot, *rest = inputs
    twice = snapshot.union(snapshot.limit(1))
    with pytest.raises(Exception, match="occurs twice"):
        ab.absence_panel(twice, *rest).select("hash_tab_num", "date").collect()


def test_panel_of_dotted_names(spark, inputs):
    """Headers of the calendar, log categories and grades may carry dots."""
    snapshot, dependents, log, _ = inputs
    snapshot = snapshot.withColumn("razryad_fact", F.when(F.col("hash_tab_num") == 1, "5.1").otherwise("6"))
    log = log.withColumn("graphic_rule_level_1", F.when(F.dayofmonth("date") == 5, "Н.Д. явка").otherwise(F.col("graphic_rule_level_1")))
    calendar = spark.createDataFrame([(m, float(m), 0.5) for m in range(1, 13)], "`Месяц` int, `налипание м.с.` double, `сложное отл.` double")
    panel = ab.absence_panel(snapshot, dependents, log, calendar)
    assert panel.count() == 30 and not [c for c in panel.columns if "." in c]
    row = panel.where("hash_tab_num = 1 AND date = '2018-05-01'").first()
    assert row["nalipanie_m_s_"] == 5.0 and row["slozhnoe_otl_"] == 0.5 and row["razryad_fact_5_1"] == 1
    assert row["cnt_days_graphic_rule_level_1_N_D__javka"] == 1
