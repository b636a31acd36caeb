import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from quorumlens.session import configure  # noqa: E402

TESTDATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    builder = configure(SparkSession.builder.master("local[4]").appName("tests"))
    session = (
        builder.config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return TESTDATA


def rows(df):
    """Rows as plain tuples in a stable order."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: tuple(str(v) for v in r))


@pytest.fixture(scope="session")
def bank(spark):
    """A small event table: two products, three months, few accounts."""
    data = []
    number = 0
    for month in (1, 2, 3):
        for account in range(8):
            if month == 2 and account >= 3:
                continue  # February has three accounts only
            for day in (3, 17):
                number += 1
                product = "CHEQUING" if account % 2 == 0 else "SAVINGS"
                name, amount = ("deposit", "100.50") if day == 3 else ("withdrawal", "-40.25")
                data.append(
                    (f"E{number}", f"2024-0{month}-{day:02d} 09:00:00", f"A{account}",
                     f"C{account // 2}", product, "money_movement", name, "DIGITAL", amount)
                )
    data.append(("E900", "2024-03-31 10:00:00", "A1", "C0", "SAVINGS", "fee", "monthly_fee", "BATCH", "-5.00"))
    data.append(("E901", "2024-03-31 11:00:00", "A1", "C0", "SAVINGS", "account_status", "frozen", "BRANCH", None))
    df = spark.createDataFrame(
        data,
        "event_id string, ts string, account_id string, customer_id string, product_type string, "
        "event_type string, event_name string, channel string, amount string",
    )
    return df.selectExpr(
        "event_id", "timestamp(ts) AS event_ts", "date(ts) AS event_date", "account_id", "customer_id",
        "product_type", "event_type", "event_name", "channel",
        "CAST(amount AS DECIMAL(18,2)) AS event_amount", "'CAD' AS currency",
    )
