"""Explicit schemas of the hospital tables and of the tables between the stages."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "string": T.StringType(), "time": T.TimestampNTZType(), "bool": T.BooleanType()}


def struct(spec: str) -> T.StructType:
    """A schema from "name kind, name kind"."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (part.split() for part in spec.split(","))])


# Input columns that the engine projects; file names are those of the hospital data set.
INPUTS = {
    "icustays": struct("subject_id long, hadm_id long, stay_id long, intime time, outtime time"),
    "patients": struct("subject_id long, anchor_age int, anchor_year int, dod string, gender string"),
    "chartevents": struct("hadm_id long, stay_id long, itemid long, charttime time, value string, valuenum double, valueuom string"),
    "labevents": struct("hadm_id long, itemid long, charttime time, value string, valuenum double, valueuom string"),
    "outputevents": struct("stay_id long, itemid long, charttime time, value double, valueuom string"),
    "d_items": struct("itemid long, label string, abbreviation string, unitname string, param_type string"),
    "inputevents": struct("stay_id long, itemid long, starttime time, endtime time, amount double, amountuom string, patientweight double"),
}
EVENTS = struct("hadm_id long, stay_id long, itemid long, charttime time, value string, valuenum double, valueuom string, source string, name string")
PREDICTIONS = struct("sample_id long, signal string, minute double, actual double, predicted_median double, predicted_mean double, predicted_p025 double, predicted_p975 double")
