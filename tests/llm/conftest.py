import pytest


@pytest.fixture(scope="session")
def corpus_spark(spark):
    from skyledger.llm.common import prepare
    return prepare(spark)


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]
