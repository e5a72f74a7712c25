"""pathlume: behavioural cohort and funnel analytics, and large-table data care, on Spark DataFrames."""

__version__ = "0.1.0"
