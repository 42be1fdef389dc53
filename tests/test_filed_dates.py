from pyspark.sql import functions as F

from tessera.functions import numbers
from tessera.plans import text_queries as T


def test_years_of_every_format(spark):
    cases = {"20180202": 2018, "2018-02-02": 2018, "02/02/2018": 2018, "on 20191231.": 2019, "20181302": None, "20180232": None, "120180202": None, "201802021": None, "19950101": None, "19950101, then 20050607": 2005, "20180": None, "": None, None: None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r.t: r.y for r in df.select("t", numbers.first_year(F.col("t")).alias("y")).collect()} == cases


def test_filed_dates_keep_every_complaint(spark, small):
    whole = T.filed_dates(spark, small)
    assert whole.count() == T.complaints(spark, small).select("complaint_id").distinct().count()
    packed = T.complaints(spark, small, "date_filed").where(F.col("date_filed").rlike("^[0-9]{8}$")).join(whole, "complaint_id").collect()
    assert packed and all(r.digits == int(r.date_filed) and r.year == int(r.date_filed[:4]) for r in packed)
