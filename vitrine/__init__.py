"""vitrine: ranking and merchandising for every user in one Spark job.

Operators take and return DataFrames.  ``vitrine.sources`` builds the users,
products, events and experiments tables, ``vitrine.operators`` holds the work
on them, ``vitrine.functions`` the column expressions they share,
``vitrine.plans`` the registered queries with their reference SQL, and
``vitrine.streaming`` the same operators over arriving requests.
"""
