"""termsieve: feature selection and classification of labelled text on Spark DataFrames."""
