"""Words, orders and labels the indicators are defined by.

Nothing here is logic. Every operator takes a ``Vocabulary`` and defaults to
``DOMAIN``, so data that uses other words needs other values, not other code.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values: place names that arrive misspelt -------------------------
PATIENT_PLACE_FIXES = {
    "PARC DELS PRÍNCEPS UN EL": "FOGARS DE LA SELVA",
    "VALL DE CARDÓS LA": "VALL DE CARDÓS",
    "SAUS. CAMALLERA I LLAMPAIES": "SAUS",
    "SANT MIQUEL DE BALANYÀ": "SANT MIQUEL DE BALENYA",
    "CRUÏLLES. MONELLS I SSADURNÍ L'HEURA": "MONELLS",
    "FALS": "FONOLLOSA",
    "CALVET EL": "CALVET",
}
CONTACT_PLACE_FIXES = {
    "SANT MIQUEL DE BALANYÀ": "SANT MIQUEL DE BALENYA",
    "CRUÏLLES. MONELLS I SSADURNÍ L'HEURA": "MONELLS",
}

# ---- fixed values: gazetteer categories that count as a settlement ----------
SETTLEMENT_CATEGORIES = ("Municipi", "Població", "Ciutat", "Poble", "Vila")

# ---- fixed values: sentinels that stand for a missing value -----------------
MISSING_UVE = "N/A"
MISSING_PLACE = "NULL"

# ---- fixed values: territory display names (regular expression, new text) ---
DISPLAY_RULES = (
    ("Barcelona$", "Barcelona Ciutat"),
    ("Barcelonès Sud", "Barcelona Sud"),
    ("Vallès Oriental i Vallès Occidental", "Vallès"),
)
MERGED_TERRITORIES = {
    "Tarragona": "Tarragona i Terres de L'Ebre",
    "Terres de l'Ebre": "Tarragona i Terres de L'Ebre",
}

# ---- fixed values: exposure settings, in display order ----------------------
SETTINGS = (
    "social",
    "medi transport",
    "laboral",
    "domicili",
    "centre sociosanitari",
    "centre sanitari",
    "altres",
)
SCHOOL_SETTING = "escolar"
UNKNOWN_SETTING = "desconegut"

# ---- fixed values: age bands (label, first age, last age), in order ---------
AGE_BANDS = (
    ("< 12 anys", None, 11),
    ("12-19 anys", 12, 19),
    ("20-39 anys", 20, 39),
    ("40-59 anys", 40, 59),
    ("60-79 anys", 60, 79),
    ("> 79 anys", 80, None),
)

# ---- fixed values: verification outcomes ------------------------------------
OUTCOMES = (
    "CIP vàlid",
    "error dades",
    "rebutja",
    "no contesta",
    "CIP no vàlid",
    "és cas",
    "contacte altre cas",
    "migrat SVE",
    "no és contacte",
    "contacte no vàlid",
)
MERGED_OUTCOMES = {"contacte no vàlid": "no és contacte"}
SCHOOL_NO_ANSWER_LABEL = 'No contesta ("escolar")'
# label, block: block "a" is followable, block "b" is not
OUTCOME_LABELS = (
    ("Cip vàlid", "a"),
    ("Error dades", "a"),
    ("Rebutja", "a"),
    ("No contesta", "a"),
    ("Cip no vàlid", "a"),
    ("És cas", "b"),
    ("Contacte altre cas", "b"),
    ("Migrat SVE", "b"),
    ("No és contacte", "b"),
    (SCHOOL_NO_ANSWER_LABEL, "b"),
)
NOT_FOLLOWABLE_OUTCOMES = (
    "migrat SVE",
    "contacte altre cas",
    "no és contacte",
    "és cas",
    "contacte no vàlid",
)

# ---- fixed values: follow-up days and the snapshot weeks that can hold them -
FOLLOWUP_WEEKS = {7: (-2,), 10: (-2, -3), 14: (-3,)}

# ---- fixed values: result tables written each week (our name, sheet name) ---
SHEET_NAMES = {
    "weekly_summary": "Resum_setmanal",
    "case_contact_indicators": "Indicadors1_2",
    "origin_split": "Origen_dades",
    "contacts_per_case": "Taula5",
    "heavy_reporters": "Superspreaders",
    "week_over_week": "Taula3",
    "outcome_totals": "Indicadors_3_Totals",
    "outcome_by_territory": "Indicadors_3_SVE",
    "setting_by_territory": "Àmbits_sve",
    "setting_totals": "Àmbits_totals",
    "school_split": "Taula_Escoles",
    "setting_by_age": "Àmbits_Rang",
    "setting_by_territory_age": "Àmbits_Rang_SVE_mes",
    "setting_by_outcome": "Àmbits_verificació",
    "symptomatic": "Simptomàtics",
    "asymptomatic": "Asimptomàtics",
    "followups": "Seguiment",
    "isolation_reasons": "Motius_no_confinament_SVE",
    "outcome_breakdown": "Taula8",
    "school_no_answer": "Escolars.NoContesten",
    "infographic": "Taula_infogr",
    "national_summary_es": "taula Madrid SVE",
    "province_summary": "Taula Madrid provicias",
    "became_cases": "Ind4_EsCas",
}

# ---- fixed values: labels of the summary measures ---------------------------
MEASURE_LABELS = {
    "cases": "1.1. Nombre total de casos nous confirmats",
    "reporting_cases": "1.2. Nombre de casos nous informats",
    "reporting_pct": "1.3. Percentatge de casos en els que s'identifiquen contactes",
    "total_contacts": "2.1. Nombre total de contactes estrets identificats",
    "mean_contacts": "2.2. Mitjana de contactes estrets identificats per cas",
    "verified": "3.1. Total de contactes estrets verificats (excloent 3.1b)",
    "accepted": "3.2. Nombre de CE als que se’ls fa la “trucada 0” de seguiment i accepten",
    "accepted_pct": "3.3. Percentatge de CE nous que fan seguiment",
    "in_followup": "3.4. Total de contactes en seguiment (trucada 0, 7 i 14 dies)",
    "symptomatic": "4.1. Nombre total de contactes que desenvolupen símptomes",
    "symptomatic_pct": "4.2. Percentatge de contactes estrets desenvolupen símptomes",
    "confirmed": "4.3. Nombre total de contactes estrets que es confirmen com a cas",
    "confirmed_pct": "4.4. Percentatge de contactes estrets que es confirmen com a cas",
}
# ---- fixed values: lines of the weekly report (ord, label, measure, how the value is written)
WEEKLY_LINES = (
    (1, "1. Casos", None, None),
    (2, MEASURE_LABELS["cases"], "cases", "number"),
    (3, MEASURE_LABELS["reporting_cases"], "reporting_cases", "number"),
    (4, MEASURE_LABELS["reporting_pct"], "reporting_pct", "percent"),
    (5, "", None, None),
    (6, "2. Contactes", None, None),
    (7, MEASURE_LABELS["total_contacts"], "total_contacts", "number"),
    (8, MEASURE_LABELS["mean_contacts"], "mean_contacts", "number"),
    (9, "2.2.a Mediana (q25-q75)", "median_contacts", "text"),
    (10, "2.2.b (mínim-màxim)", "max_contacts", "text"),
    (11, "", None, None),
    (12, "3. Seguiment", None, None),
    (13, "3.1. Total de contactes verificats", "all_outcomes", "number"),
    (14, "3.1a", "block_a", "number"),
    (15, "3.1b", "block_b", "number"),
    (16, MEASURE_LABELS["accepted"], "accepted", "number"),
    (17, MEASURE_LABELS["accepted_pct"], "accepted_pct", "percent"),
    (18, "3.3. sense escolars que no contesten", "accepted_pct_no_school", "percent"),
    (19, MEASURE_LABELS["in_followup"], "in_followup", "number"),
    (20, "", None, None),
    (21, "4. Evolució", None, None),
    (22, MEASURE_LABELS["symptomatic"], "symptomatic", "number"),
    (23, MEASURE_LABELS["symptomatic_pct"], "symptomatic_pct", "percent"),
    (24, MEASURE_LABELS["confirmed"], "confirmed", "number"),
    (25, MEASURE_LABELS["confirmed_pct"], "confirmed_pct", "percent"),
    (26, "", None, None),
)
SPANISH_LABELS = {
    "sve": "Subdivisión territorial epidemiológica",
    "cases": "Número total de casos notificados",
    "contacts": "Número total de contactos estrechos",
    "symptomatic": "Número de contactos estrechos que desarrollan síntomas",
    "confirmed": "Número de contactos estrechos que se confirman como casos",
}

# ---- fixed values: column headers of exported tables ({now}, {before}: ISO weeks)
COLUMN_LABELS = {
    "case_contact_indicators": {
        "sve": "SVE",
        "cases": "1.1-casos_totals",
        "reporting_cases": "1.2-N_casos_reporten_contactes",
        "reporting_pct": "1.3-%casos amb contactes",
        "total_contacts": "2.1-N total de CE",
        "mean_contacts": "2.2-Mitjana",
        "median_contacts": "2.2Mediana",
        "iqr_contacts": "2.2-IQR",
        "min_contacts": "2.2-Min",
        "max_contacts": "2.2-max",
    },
    "origin_split": {
        "sve": "SVE",
        "first_n": "Origen_eCap",
        "first_pct": "%Origen_eCAP",
        "second_n": "Origen_COVID19",
        "second_pct": "%Origen_COVID19",
        "total": "TOTAL",
    },
    "outcome_totals": {"outcome": "verificació", "n_contacts": "N_contactes"},
    "outcome_by_territory": {"sve": "SVE"},
    "outcome_breakdown": {"label": "verificació", "n": "N", "pct": "Percentatge"},
    "school_no_answer": {"sve": "SVE", "n": "N", "pct": "Percentatge"},
    "setting_totals": {"setting": "àmbit contacte", "n_contacts": "N_contactes"},
    "setting_by_territory": {"sve": "SVE"},
    "setting_by_age": {"age_band": "Rang_edat"},
    "setting_by_territory_age": {"sve": "SVE", "age_band": "Rang_edat", "total": "Totals"},
    "setting_by_outcome": {"setting": "àmbit contacte"},
    "infographic": {"label": "Indicadors"},
    "week_over_week": {
        "sve": "SVE",
        "informed": "I",
        "not_informed": "NI",
        "total": "Total",
        "informed_pct": "%_I_SE{now}",
        "previous_informed_pct": "%_I_SE{before}",
        "change_points": "Variació %",
    },
    "contacts_per_case": {
        "n_contacts": "contactes",
        "informed_cases": "nº casos informats",
        "pct": "% de casos amb CE",
    },
    "school_split": {
        "sve": "SVE",
        "cases_with_school": "Casos amb contactes escolars",
        "cases_without_school": "Casos sense contactes escolars",
        "school_contacts": "Contactes àmbit escolar",
        "other_contacts": "Contactes àmbit no escolar",
        "school_ratio": "CE/CI àmbit escolar",
        "other_ratio": "CE/CI àmbit no escolar",
    },
    "heavy_reporters": {
        "cip": "CIP",
        "gender": "gènere",
        "age": "Edat",
        "place_name": "nom_unitat_de_poblacio",
        "sve": "SVE",
        "n_contacts_reported": "N_contactes_segons_pestanya_pacients",
        "n_contacts_listed": "N_contactes_segons_pestanya_contactes",
    },
    "became_cases": {
        "sve": "SVE", "no_n": "No_N", "no_pct": "No_%", "yes_n": "Si_N", "yes_pct": "Si_%", "total_n": "Total_N",
    },
    "followups": {
        "sve": "SVE", "status": "Estat", "day7": "Seguiment_dia7", "day10": "Seguiment_dia10", "day14": "Seguiment_dia14",
    },
    "isolation_reasons": {
        "sve": "SVE", "reason": "Motiu", "day7": "Motius_dia_7", "day10": "Motius_dia_10", "day14": "Motius_dia_14",
    },
    "symptomatic": {
        "sve": "SVE",
        "day0": "Simptomàtics_dia0",
        "day7": "Simptomàtics_dia_7",
        "day10": "Simptomàtics_dia_10",
        "day14": "Simptomàtics_dia_14",
        "total": "Totals",
    },
    "asymptomatic": {
        "sve": "SVE",
        "day0": "Asimptomàtics_dia0",
        "day7": "Asimptomàtics_dia_7",
        "day10": "Asimptomàtics_dia_10",
        "day14": "Asimptomàtics_dia_14",
        "total": "Totals",
    },
    "province_summary": {
        "province": "Provincia",
        "cases": "Casos notificats",
        "contacts": "Total de CE",
        "symptomatic": "CE que desenvolupen símptomes",
        "confirmed": "CE que es confirmen com a Casos",
    },
    "national_summary": {
        "sve": "SVE",
        "cases": "Total de casos notificats",
        "cases_pct": "Percentatge(%)",
        "contacts": "Contactes estrets(CE)",
        "symptomatic": "CE amb símptomes",
        "confirmed": "CE que es confirmen com a cas",
    },
    "weekly_summary": {"label": "Indicadors", "value_text": "Valor SE{now}"},
}


#: Tables whose columns are settings or outcomes, under those words; what is in none of them stands under the last.
SETTING_TABLES = ("setting_by_territory", "setting_by_age", "setting_by_territory_age", "heavy_reporters")
OUTCOME_TABLES = ("outcome_by_territory", "setting_by_outcome")
OTHER_LEVELS_LABEL = "<NA>"
#: Columns that only the operators need.
UNSHOWN_COLUMNS = ("is_total", "ord", "kind", "block", "measure", "q25_contacts", "q75_contacts")


@dataclass(frozen=True)
class Vocabulary:
    """The words a data set uses for the concepts the operators count."""

    settlement_categories: tuple[str, ...] = SETTLEMENT_CATEGORIES
    patient_place_fixes: dict[str, str] = field(default_factory=lambda: dict(PATIENT_PLACE_FIXES))
    contact_place_fixes: dict[str, str] = field(default_factory=lambda: dict(CONTACT_PLACE_FIXES))
    missing_uve: str = MISSING_UVE
    missing_place: str = MISSING_PLACE
    display_rules: tuple[tuple[str, str], ...] = DISPLAY_RULES
    merged_territories: dict[str, str] = field(default_factory=lambda: dict(MERGED_TERRITORIES))
    settings: tuple[str, ...] = SETTINGS
    school: str = SCHOOL_SETTING
    unknown_setting: str = UNKNOWN_SETTING
    outcomes: tuple[str, ...] = OUTCOMES
    merged_outcomes: dict[str, str] = field(default_factory=lambda: dict(MERGED_OUTCOMES))
    outcome_labels: tuple[tuple[str, str], ...] = OUTCOME_LABELS
    school_no_answer_label: str = SCHOOL_NO_ANSWER_LABEL
    not_followable: tuple[str, ...] = NOT_FOLLOWABLE_OUTCOMES
    no_answer: str = "no contesta"
    became_case: str = "és cas"
    accepted: str = "CIP vàlid"
    origins: tuple[str, str] = ("eCap", "COVID19")
    done: str = "Realitzat"
    live_status: tuple[str, ...] = ("Realitzat", "Pendent")
    yes: str = "Sí"
    no: str = "No"
    placeholder: str = "Sense seguiments"
    total: str = "Totals"


DOMAIN = Vocabulary()
