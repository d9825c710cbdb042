"""Physical building blocks shared by the operators: bounded sides, ranks, storage."""
