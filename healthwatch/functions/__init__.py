from healthwatch.functions import fields  # noqa: F401
