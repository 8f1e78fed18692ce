"""Vector and probability expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperlode.functions.basic import bind


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def safe_norm(a: Column) -> Column:
    """Length of a vector, 1 for the zero vector."""
    return bind(norm(a), lambda length: F.when(length == 0, F.lit(1.0)).otherwise(length))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (safe_norm(a) * safe_norm(b))


def l2_normalize(a: Column) -> Column:
    return bind(safe_norm(a), lambda n: F.transform(a, lambda x: x.cast("double") / n))


def softmax(logits: Column) -> Column:
    """Class probabilities; not-a-number results become 0."""

    def shares(powers: Column) -> Column:
        total = F.aggregate(powers, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(powers, lambda x: F.nanvl(x / t, F.lit(0.0))))

    powers = bind(F.array_max(logits), lambda top: F.transform(logits, lambda x: F.exp(x - top)))
    return bind(powers, shares)


def arg_max(values: Column) -> Column:
    """Position of the largest value, the first on ties, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def confidence(probabilities: Column) -> Column:
    return F.array_max(probabilities)
