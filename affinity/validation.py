"""argument checks at the edge of the API."""

# The algorithms and rating kinds a request may name.
ALGORITHMS = ("ALS", "ASR", "CAR")
RATINGS = ("explicit", "implicit")
SOURCES = ("text", "parquet")
SINKS = ("csv", "parquet")


def one_of(name: str, value, allowed) -> None:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}, got {value!r}")


def check_algorithm(algorithm: str) -> None:
    one_of("algorithm", algorithm, ALGORITHMS)


def check_rating(rating: str) -> None:
    one_of("rating", rating, RATINGS)


def check_build(algorithm: str, rating: str | None = None, **required) -> None:
    """A build names a known algorithm, a rating kind (rules need none) and its ids."""
    check_algorithm(algorithm)
    if algorithm != "ASR":
        check_rating(rating)
    for name, value in required.items():
        if not value:
            raise ValueError(f"{name} is required")


def check_columns(df, columns, what: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks the columns {', '.join(missing)}")
