from millrace.plans.app import options


def test_where_programs_run():
    from millrace.plans.app import App

    made = []

    class Builder:
        def __getattr__(self, name):
            return lambda *a: (made.append((name, *a)), self)[1]

    for argv, master in (([], None), (["--local"], "local[*]"), (["--inmemory"], "local[1]"), (["--master", "local[3]"], "local[3]"), (["--local", "--cluster"], None)):
        made.clear()
        o = options().parse_args(argv)
        import pyspark.sql

        own, pyspark.sql.SparkSession.builder = pyspark.sql.SparkSession.builder, Builder()
        try:
            App().session(o)
        finally:
            pyspark.sql.SparkSession.builder = own
        assert [m[1] for m in made if m[0] == "master"] == ([master] if master else [])
