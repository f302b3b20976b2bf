"""Operations on documents and pages: DataFrame in, DataFrame out."""
