import pytest

from millrace.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("millrace-tests", cores=8)
    yield session
    session.stop()


@pytest.fixture
def rows():
    """Collected rows as a sorted list of tuples, nulls first."""

    def sort_key(row):
        return tuple((v is not None, v) for v in row)

    def collect(df, *columns):
        chosen = df.select(*columns) if columns else df
        return sorted((tuple(r) for r in chosen.collect()), key=sort_key)

    return collect
