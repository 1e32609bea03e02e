"""Operations of a pipeline that prepares training data. Nothing else in the library imports this subpackage."""
