"""sparkloom: profiling, cleaning, deduplication and search of tabular data, declared as Spark plans."""
