"""The named jobs: operators composed over the inputs of one data folder."""
