"""Query registry of the driver contract: Spark callables and the SQL that checks them."""
