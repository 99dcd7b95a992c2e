"""Query plans: each registered query is a function (spark, sf_dir) -> DataFrame
built from the operators, plus its DuckDB/ANSI-SQL oracle."""
