"""Feature rules as data: one row for each feature, and the item identifiers as a parameter.

The rules hold for every data set of the same source; the map from item identifiers to features is read from a table
(feature, itemid) that the user keeps beside the raw data, since it has several hundred rows. Bounds are inclusive.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

DROP, MEDIAN, KEEP = "drop", "median", "keep"

# Feature, lowest and highest value and unit, for features of charts and laboratories.
MEASURED = [
    ("DBP", 0, 375, "mmHg"),
    ("SBP", 0, 375, "mmHg"),
    ("MBP", 0, 375, "mmHg"),
    ("HR", 0, 390, "bpm"),
    ("RR", 0, 330, "brpm"),
    ("Temperature", 14.2, 47, "C"),
    ("Weight", 0, 300, "kg"),
    ("Height", 0, 275, "cm"),
    ("FiO2", 0.2, 1, None),
    ("Glucose (Blood)", 0, 2200, "mg/dL"),
    ("Glucose (Whole Blood)", 0, 2200, "mg/dL"),
    ("Glucose (Serum)", 0, 2200, "mg/dL"),
    ("Bilirubin (Total)", 0, 66, "mg/dL"),
    ("Bilirubin (Direct)", 0, 66, "mg/dL"),
    ("Bilirubin (Indirect)", 0, 66, "mg/dL"),
    ("O2 Saturation", 0, 100, "%"),
    ("Sodium", 0, 250, "mEq/L"),
    ("Potassium", 0, 15, "mEq/L"),
    ("Magnesium", 0, 22, "mg/dL"),
    ("Phosphate", 0, 22, "mg/dL"),
    ("Calcium Total", 0, 40, "mg/dL"),
    ("Calcium Free", 0, 10, "mmol/L"),
    ("WBC", 0, 1100, "K/uL"),
    ("Hct", 0, 100, "%"),
    ("Hgb", 0, 30, "g/dL"),
    ("Chloride", 0, 200, "mEq/L"),
    ("Bicarbonate", 0, 66, "mEq/L"),
    ("ALT", 0, 11000, "IU/L"),
    ("ALP", 0, 4000, "IU/L"),
    ("AST", 0, 22000, "IU/L"),
    ("Albumin", 0, 10, "g/dL"),
    ("Lactate", 0, 33, "mmol/L"),
    ("LDH", 0, 35000, "IU/L"),
    ("SG Urine", 0, 2, None),
    ("pH Urine", 0, 14, None),
    ("pH Blood", 0, 14, None),
    ("PO2", 0, 770, "mmHg"),
    ("PCO2", 0, 220, "mmHg"),
    ("Total CO2", 0, 65, "mEq/L"),
    ("Base Excess", -31, 28, "mEq/L"),
    ("Monocytes", 0, 100, "%"),
    ("Basophils", 0, 100, "%"),
    ("Eoisinophils", 0, 100, "%"),
    ("Neutrophils", 0, 100, "%"),
    ("Lymphocytes", 0, 100, "%"),
    ("Lymphocytes (Absolute)", 0, 25000, "#/uL"),
    ("PT", 0, 150, "sec"),
    ("PTT", 0, 150, "sec"),
    ("INR", 0, 150, None),
    ("Anion Gap", 0, 55, "mg/dL"),
    ("BUN", 0, 275, "mEq/L"),
    ("Creatinine Blood", 0, 66, "mg/dL"),
    ("Creatinine Urine", 0, 650, "mg/dL"),
    ("MCH", 0, 50, "pg"),
    ("MCHC", 0, 50, "%"),
    ("MCV", 0, 150, "fL"),
    ("RDW", 0, 37, "%"),
    ("Platelet Count", 0, 2200, "K/uL"),
    ("RBC", 0, 14, "m/uL"),
]
# The same for fluid outputs and for given drugs and fluids; missing and outlying values become medians.
OUTPUTS = [
    ("Ultrafiltrate", 0, 7000, "mL"),
    ("Urine", 0, 2500, "mL"),
    ("Stool", 0, 4000, "mL"),
    ("Chest Tube", 0, 2500, "mL"),
    ("Gastric", 0, 4000, "mL"),
    ("EBL", 0, 10000, "mL"),
    ("Emesis", 0, 2000, "mL"),
    ("Jackson-Pratt", 0, 2000, "ml"),
    ("Residual", 0, 1050, "mL"),
    ("Pre-admission Output", 0, 13000, "ml"),
]
INPUTS = [
    ("Midazolam", 0, 500, "mg"),
    ("Propofol", 0, 12000, "mg"),
    ("Albumin 25%", 0, 750, "ml"),
    ("Albumin 5%", 0, 1300, "ml"),
    ("Fresh Frozen Plasma", 0, 33000, "ml"),
    ("Lorazepam", 0, 300, "mg"),
    ("Morphine Sulfate", 0, 4000, "mg"),
    ("Gastric Meds", 0, 7000, "ml"),
    ("Lactated Ringers", 0, 17000, "ml"),
    ("Milrinone", 0, 50, "ml"),
    ("OR/PACU Crystalloid", 0, 22000, "ml"),
    ("Packed RBC", 0, 17250, "ml"),
    ("PO intake", 0, 11000, "ml"),
    ("Neosynephrine", 0, 1200, "mg"),
    ("Piggyback", 0, 1000, "ml"),
    ("Nitroglycerine", 0, 350, "mg"),
    ("Nitroprusside", 0, 430, "mg"),
    ("Metoprolol", 0, 151, "mg"),
    ("Norepinephrine", 0, 80, "mg"),
    ("Colloid", 0, 20000, "ml"),
    ("Hydralazine", 0, 80, "mg"),
    ("GT Flush", 0, 2100, "ml"),
    ("Hydromorphone", 0, 125, "mg"),
    ("Fentanyl", 0, 20, "mg"),
    ("Insulin Regular", 0, 1500, "units"),
    ("Insulin Humalog", 0, 340, "units"),
    ("Insulin largine", 0, 150, "units"),
    ("Insulin NPH", 0, 100, "units"),
    ("Unknown", 0, 1100, "ml"),
    ("D5W", 0, 11000, "ml"),
    ("Dextrose Other", 0, 4000, "ml"),
    ("Normal Saline", 0, 11000, "ml"),
    ("Half Normal Saline", 0, 2000, "ml"),
    ("Sterile Water", 0, 10000, "ml"),
    ("Free Water", 0, 2500, "ml"),
    ("Solution", 0, 1500, "ml"),
    ("Dopamine", 0, 1300, "mg"),
    ("Epinephrine", 0, 100, "mg"),
    ("Amiodarone", 0, 1200, "mg"),
    ("TPN", 0, 1600, "ml"),
    ("Magnesium Sulfate (Bolus)", 0, 250, "ml"),
    ("KCl (Bolus)", 0, 500, "ml"),
    ("Pre-admission Intake", 0, 30000, "ml"),
]
# Drugs whose valid rows also depend on the unit: feature, lowest, highest, unit, valid units, whether zero
# counts whatever the unit, whether mg become g before the test.
DRUGS = [
    ("Vasopressin", 0, 400, "units", ["U", "units"], True, False),
    ("Vancomycin", 0, 8, "g", [], False, True),
    ("Calcium Gluconate", 0, 200, "g", ["mg", "gm", "grams"], True, True),
    ("Furosemide", 0, 250, "mg", ["mg"], True, False),
    ("Famotidine", 0, 1, "dose", ["dose"], True, False),
    ("Piperacillin", 0, 1, "dose", ["dose"], True, False),
    ("Cefazolin", 0, 2, "dose", ["dose"], True, False),
    ("Fiber", 0, 1600, "ml", ["ml"], True, False),
    ("Pantoprazole", 0, float("inf"), "dose", [], False, False),
    ("Magnesium Sulphate", 0, 125, "g", ["gm", "grams", "mg"], True, True),
    ("KCl", 0, 501, "mEq", ["mEq", "mEq."], True, False),
    ("Heparin", 0, 25300, "units", ["U", "units"], False, False),
]
# Label keywords of output features, text codes, forecast targets and interventions.
KEYWORDS = {
    "Urine": ["urine", "foley", "void", "nephrostomy", "condom", "drainage bag"],
    "Stool": ["stool", "fecal", "colostomy", "ileostomy", "rectal"],
    "Chest Tube": ["chest tube"],
    "Jackson-Pratt": ["jackson"],
}
CODES = {
    "CRR": (["Normal <3 Seconds", "Normal <3 secs"], ["Abnormal >3 Seconds", "Abnormal >3 secs"]),
    "Intubated": (["NOT INTUBATED"], ["INTUBATED"]),
}
DROPPED_TEXT = {"CRR": "Other/Remarks"}
BINARY = ("Pantoprazole",)
UNBOUNDED = ("GCS_eye", "GCS_motor", "GCS_verbal", "CRR", "Intubated")
CHART_ONLY = ("DBP", "SBP", "MBP", "GCS_eye", "GCS_motor", "GCS_verbal", "HR", "RR", "Temperature", "Weight", "Height", "FiO2", "CRR")
LAB_ONLY = ("Intubated",)
TARGETS = ["HR", "SBP", "DBP", "Temperature", "O2 Saturation"]
INTERVENTIONS = [
    "Intubated", "FiO2", "Norepinephrine", "Vasopressin", "Dopamine", "Epinephrine", "Neosynephrine", "Milrinone", "Propofol", "Midazolam",
    "Fentanyl", "Normal Saline", "Lactated Ringers", "Packed RBC", "Fresh Frozen Plasma", "Albumin 5%", "Albumin 25%", "OR/PACU Crystalloid",
]
# How reports show the targets.
SHOWN_NAMES = {"O2 Saturation": "SpO₂"}
SHOWN_UNITS = {"HR": "bpm", "SBP": "mmHg", "DBP": "mmHg", "Temperature": "°C", "O2 Saturation": "%"}
# Items measured in other units, with factor and offset to the feature's unit.
CONVERTED_ITEMS = {
    223761: (5 / 9, -160 / 9), 678: (5 / 9, -160 / 9), 679: (5 / 9, -160 / 9), 3654: (5 / 9, -160 / 9),
    226531: (0.453592, 0.0), 1394: (2.54, 0.0), 226707: (2.54, 0.0),
}


@dataclass(frozen=True)
class Rule:
    """How the raw values of one feature become clean ones."""

    feature: str
    sources: tuple[str, ...]
    low: float | None
    high: float | None
    unit: str | None
    policy: str
    units: tuple[str, ...] = field(default=())
    zero_ok: bool = False
    to_grams: bool = False


def _rule(name: str, low: float, high: float, unit: str | None, units=(), zero: bool = False, grams: bool = False, *, sources: tuple[str, ...], policy: str) -> Rule:
    own = ("chart",) if name in CHART_ONLY else sources
    return Rule(name, own, float(low), float(high), unit, policy, tuple(units), zero, grams)


def rules() -> list[Rule]:
    """The rules of all features."""
    kept = [Rule(name, ("lab",) if name in LAB_ONLY else ("chart",), None, None, None, KEEP) for name in UNBOUNDED]
    return [
        *(_rule(*r, sources=("chart", "lab"), policy=DROP) for r in MEASURED), *kept, *(_rule(*r, sources=("output",), policy=MEDIAN) for r in OUTPUTS),
        *(_rule(*r, sources=("input",), policy=MEDIAN) for r in DRUGS), *(_rule(*r, sources=("input",), policy=MEDIAN) for r in INPUTS),
    ]


def rule_table(spark: SparkSession, given: list[Rule] | None = None) -> DataFrame:
    """The rules as a table with one row for each feature and source."""
    rows = [
        (r.feature, s, r.low, r.high, r.unit, r.policy, list(r.units), r.zero_ok, r.to_grams, r.feature in BINARY, r.feature == "FiO2")
        for r in given or rules()
        for s in r.sources
    ]
    kinds = "feature string, source string, low double, high double, unit string, policy string, units array<string>, zero_ok boolean, to_grams boolean, binary boolean, percent boolean"
    return spark.createDataFrame(rows, kinds)


def item_table(items: DataFrame) -> DataFrame:
    """feature, itemid, factor and offset from a table of feature and itemid."""
    from pyspark.sql import functions as F

    factor, offset = F.lit(1.0), F.lit(0.0)
    for item, (f, o) in CONVERTED_ITEMS.items():
        factor = F.when(F.col("itemid") == item, F.lit(f)).otherwise(factor)
        offset = F.when(F.col("itemid") == item, F.lit(o)).otherwise(offset)
    return items.select("feature", F.col("itemid").cast("long").alias("itemid"), factor.alias("factor"), offset.alias("offset")).distinct()
