"""folio: investment-ledger analytics as Spark DataFrame transformations."""
