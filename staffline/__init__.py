"""staffline — workforce analytics (headcount, attrition, tenure, risk) as Spark DataFrame jobs.

Every operator takes and returns a DataFrame and is lazily planned; nothing is collected to
the driver. See README.md for the operator list.
"""

__version__ = "0.1.0"
