"""The panel of sick leave per employee and month: input schemas, codes and column names."""

from __future__ import annotations

from pyspark.sql import DataFrame

from panelweave.plans.panel import (
    DependentSpec,
    LogSpec,
    PanelLevels,
    PanelSpec,
    SnapshotSpec,
    build_panel,
)

# Column types of the snapshot, dependents, log and template files (`;` files).
TEMPLATE_SCHEMA = "hash_tab_num BIGINT, date DATE, target INT"
DEPENDENTS_SCHEMA = "hash_tab_num BIGINT, rel_type STRING, rel_birth INT"
LOG_SCHEMA = (
    "hash_tab_num BIGINT, date DATE, work_shift_type STRING, number_of_working_hours STRING, "
    "graphic_rule_level_1 STRING, graphic_rule_level_2 STRING"
)
SNAPSHOT_SCHEMA = (
    "hash_tab_num BIGINT, date DATE, sick INT, date_of_birth INT, gender STRING, category STRING, "
    "education STRING, razryad_fact STRING, razryad_post STRING, work_experience_all DOUBLE, "
    "work_experience_company DOUBLE, work_experience_factory DOUBLE, is_local INT, "
    "home_to_work_distance DOUBLE, name_post_lvl4 STRING, name_fact_lvl4 STRING, "
    "name_fact_lvl5 STRING"
)

# Codes of the source tables.
SHIFTS = ("Смена 1", "Смена 2", "Смена 3")
SICK_LEAVE = ("Больничный",)
SICK_CODE = ("Б",)
MALE = ("мужской",)
MALE_RELATIVES = ("Сын", "Муж", "Отец", "Пасынок", "Внук", "Брат")
CHILD_RELATIVES = (
    "Сын",
    "Дочь",
    "Пасынок",
    "Падчерица",
    "Опекаемый (воспитанник)",
    "Опекаемая (воспитанница)",
)
EDUCATION = (
    {
        "Высшее": ("Высшее образование", "Высшее-бакалавриат", "Высшее-специалитет"),
        "Среднее_профессинальное": ("Ср.профессиональное", "Нач.профессиональное"),
    },
    "Начальное_среднее",
)
CALENDAR_KEY = "Месяц"

ABSENCE = PanelSpec(
    log=LogSpec(
        entity="hash_tab_num",
        day="date",
        shift_kind="work_shift_type",
        shift_values=SHIFTS,
        hours="number_of_working_hours",
        category="graphic_rule_level_1",
        flag_values=SICK_LEAVE,
        code="graphic_rule_level_2",
        code_values=SICK_CODE,
        shift_count="work_shift_type_count",
        hours_sum="sum_work_hours",
        flag="sick",
        month_end="is_last_day",
        category_prefix="cnt_days_graphic_rule_level_1",
    ),
    dependents=DependentSpec(
        entity="hash_tab_num",
        kind="rel_type",
        birth="rel_birth",
        male_kinds=MALE_RELATIVES,
        child_kinds=CHILD_RELATIVES,
        names=(
            "rale_is_old",
            "young_children_6_cnt",
            "young_children_11_cnt",
            "young_children_6_female_cnt",
            "young_children_11_female_cnt",
        ),
    ),
    snapshot=SnapshotSpec(
        entity="hash_tab_num",
        month="date",
        flag="sick",
        birth_year="date_of_birth",
        gender="gender",
        male_values=MALE,
        experience="work_experience_all",
        peer_groups=("name_post_lvl4", "name_fact_lvl4"),
        unit="name_fact_lvl5",
        raw=(
            "is_local",
            "work_experience_company",
            "home_to_work_distance",
            "work_experience_factory",
        ),
        categories=("category", "education", "razryad_fact", "razryad_post"),
        recodes={"education": EDUCATION},
        unit_size="personel_num",
    ),
    calendar_key=CALENDAR_KEY,
)


def absence_panel(
    snapshot: DataFrame,
    dependents: DataFrame,
    log: DataFrame,
    calendar: DataFrame,
    levels: PanelLevels | None = None,
) -> DataFrame:
    """Features and 12 monthly targets per employee and month."""
    return build_panel(snapshot, dependents, log, calendar, ABSENCE, levels)
