"""lagweave: temporal rule analytics and series preparation on Spark DataFrames."""

__version__ = "0.1.0"
