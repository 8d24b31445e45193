"""Credentials out of option maps, command lines and URLs before they are stored."""

from pyspark.sql import Column, functions as F

from vellum import fixed


def redact_url(value: Column) -> Column:
    """The userinfo of every URL in the string replaced; host, path and query kept."""
    return F.regexp_replace(value, fixed.URL_USERINFO, "$1" + fixed.REDACTED + "@")


def redact_options(options: Column) -> Column:
    """Values under credential-like names hidden, other values with their URLs cleaned."""
    hidden = F.transform_values(options, lambda name, value: F.when(
        name.rlike(fixed.SECRET_NAME), F.lit(fixed.REDACTED)).otherwise(redact_url(value)))
    return F.coalesce(hidden, F.expr("cast(map() as map<string,string>)"))


def redact_argv(argv: Column) -> Column:
    """The same rule over a command line: `--flag=value`, and `--flag value` over two arguments."""
    def is_secret(arg: Column) -> Column:
        return arg.startswith("-") & F.substring_index(arg, "=", 1).rlike(fixed.SECRET_NAME)

    # An argument is hidden when the flag before it is secret, carries no value of its
    # own and was not itself hidden; walking left to right carries that one bit.
    def step(acc: Column, arg: Column) -> Column:
        shown = (F.when(acc.hide, F.lit(fixed.REDACTED))
                 .when(is_secret(arg) & arg.contains("="),
                       F.concat(F.substring_index(arg, "=", 1), F.lit("=" + fixed.REDACTED)))
                 .when(is_secret(arg), arg)
                 .otherwise(redact_url(arg)))
        return F.struct(F.array_append(acc.out, shown).alias("out"),
                        (~acc.hide & is_secret(arg) & ~arg.contains("=")).alias("hide"))

    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.lit(False).alias("hide"))
    return F.aggregate(F.coalesce(argv, F.expr("cast(array() as array<string>)")), start, step,
                       lambda acc: acc.out)
