from corvane.plans.pipeline import main

main()
