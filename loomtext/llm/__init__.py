"""Operations of a training-data pipeline. Nothing else in loomtext imports this subpackage."""
