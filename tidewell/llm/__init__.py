"""Operations for large training-text corpora, as Spark jobs over a `documents` table."""
