"""pairwell: comparable cohorts on Spark.

Load one table or merge two populations, describe and clean the columns, profile
both groups, match treated units to controls and report covariate balance.
"""

__version__ = "0.1.0"
