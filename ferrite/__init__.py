"""ferrite: personal-data detection, redaction accounting and event policies on PySpark DataFrames."""
