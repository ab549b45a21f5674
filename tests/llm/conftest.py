from tests.conftest import spark, tiny  # noqa: F401
