"""Training-data operators on Spark: each module is one operator.

Nothing outside this package imports it.  ``queries`` registers one query per
operator, ``sql`` holds the SQL each is checked against where SQL can say it.
"""
