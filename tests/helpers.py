import datetime as dt

from pyspark.sql import types as T

from staffline.schema import STAFF_SCHEMA

SCHEMA = T.StructType(STAFF_SCHEMA.fields + [T.StructField("company", T.StringType())])
COLS = [f.name for f in SCHEMA.fields]


def ts(d):
    return None if d is None else dt.datetime(d.year, d.month, d.day)


def staff_df(spark, rows):
    """Rows are dicts with date values; missing keys are null."""
    data = []
    for i, r in enumerate(rows):
        rec = {c: None for c in COLS}
        rec["employee_id"] = i + 1
        rec.update(r)
        for c in ("hire_date", "exit_date", "last_promotion", "last_merit"):
            rec[c] = ts(rec[c])
        data.append(tuple(rec[c] for c in COLS))
    return spark.createDataFrame(data, SCHEMA)


def prepared(spark, rows, as_of="2001-12-01 00:00:00"):
    from staffline.operators.prepare import prepare_staff

    return prepare_staff(staff_df(spark, rows), None, as_of)
