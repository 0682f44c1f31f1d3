"""Column names, schemas and the fixed vocabulary shared by all stages."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw retail lines as they arrive in CSV.  CustomerID is a double because the
# exported text reads like "13085.0"; cleaning casts it to a long.
RAW_LINES = T.StructType(
    [
        T.StructField("InvoiceNo", T.StringType()),
        T.StructField("StockCode", T.StringType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Quantity", T.LongType()),
        T.StructField("InvoiceDate", T.TimestampNTZType()),
        T.StructField("UnitPrice", T.DoubleType()),
        T.StructField("CustomerID", T.DoubleType()),
        T.StructField("Country", T.StringType()),
    ]
)

LINE_COLUMNS = RAW_LINES.fieldNames()
CLEAN_COLUMNS = [*LINE_COLUMNS, "TotalPrice"]

CUSTOMER = "CustomerID"
RFM = ["Recency", "Frequency", "Monetary"]
SCORES = ["R_Score", "F_Score", "M_Score"]

# Level names, lowest first, with the highest score sum of each.
LEVELS = {"Low": 6, "Mid": 9, "High": 12, "Champion": 15}

# Column names of the yearly source sheets -> our names.
LEGACY_NAMES = {"Invoice": "InvoiceNo", "Price": "UnitPrice", "Customer ID": "CustomerID"}

# Texts that a CSV reader takes as missing.
MISSING_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
